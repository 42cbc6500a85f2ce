"""Document fingerprints from prefix polynomial hashes.

Modulo two primes, the prefix array of a text's code points gives the hash of any span by a difference and a
multiplication; equality of any two spans takes one comparison, and binary search over it the longest common
extension of two places.  A fingerprint is the number of code points, the hash of the whole text and the ``KEPT``
least mixed hashes of its distinct spans of ``SPAN`` code points, each with the place where it stands first.

The likeness of two fingerprinted texts: spans that both fingerprints hold are anchors; from each, the longest common
extensions to either side, by the prefix arrays, give a stretch that the texts share.  Likeness is the share of both texts'
code points that these stretches cover, 1 for equal texts.

``compare_neighbours`` sets each document beside the next one in descending order of id.  Ranges of ids, cut at
approximate quantiles to some 16 MB of text each, form the partitions; the first document of each range is sent to the
range before it too, so that one shuffle brings all neighbours together, however the ids lie.

Defined results: null text is the empty text, whose span set is empty (likeness 1 to itself, else 0); a text
shorter than a span is its own only span; null ids come last, by hash of their text, in ranges of their own; rows that repeat
an id follow one another by hash of their text; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordblocks as W
from .scratch import prepare

U = np.uint64
#: Two Mersenne-sized primes and a base for each.
MODULI = ((2**31 - 1, 1_000_003), (2**31 - 19, 998_244_353))
SPAN, KEPT = 16, 48
#: Code points compared at once, unless one pair of texts has more.
BLOCK = 1 << 19
#: Bytes of text in a range, and the ranges at most.
RANGE_BYTES, MOST_RANGES = 16 << 20, 1 << 14
NO_ID = -(2**63)


class _Powers:
    """base**n modulo a prime, from two small tables, for any n below 2**32."""

    def __init__(self, prime: int, base: int):
        self.prime = U(prime)
        self.low, self.high = self._row(base), self._row(pow(base, 1 << 16, prime))

    def _row(self, base: int) -> np.ndarray:
        out = np.ones(1, U)
        while len(out) < 1 << 16:
            out = np.concatenate([out, out * U(pow(int(base), len(out), int(self.prime))) % self.prime])
        return out

    def at(self, n: np.ndarray) -> np.ndarray:
        return self.low[n & 0xFFFF] * self.high[n >> 16] % self.prime

    def first(self, n: int) -> np.ndarray:
        """Of 0 to n - 1."""
        out = np.empty(n, U)
        for lo in range(0, n, 1 << 16):
            out[lo : lo + (1 << 16)] = self.low[: min(1 << 16, n - lo)] * self.high[lo >> 16] % self.prime
        return out


@cache
def _powers(prime: int, base: int) -> tuple[_Powers, _Powers]:
    return _Powers(prime, base), _Powers(prime, pow(base, -1, prime))


class PrefixHashes:
    """Prefix arrays over a sequence of code points."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        self.parts = []
        for prime, base in MODULI:
            up, down = _powers(prime, base)
            prefix = np.zeros(self.n + 1, U)
            np.cumsum((points.astype(U) + U(1)) * up.first(self.n) % U(prime), out=prefix[1:])
            prefix %= U(prime)
            self.parts.append((U(prime), prefix, down))

    def span(self, begin: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """62-bit hashes of the spans of ``size`` from ``begin`` on."""
        out = []
        for prime, prefix, down in self.parts:
            out.append((prefix[begin + size] + prime - prefix[begin]) % prime * down.at(begin) % prime)
        return out[0] << U(31) | out[1]

    def spans(self, size: int) -> np.ndarray:
        """Those of all spans of one size."""
        n, out = max(self.n - size + 1, 0), []
        for prime, prefix, down in self.parts:
            out.append((prefix[size : size + n] + prime - prefix[:n]) % prime * down.first(n) % prime)
        return out[0] << U(31) | out[1]

    def extension(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray, back: bool = False) -> np.ndarray:
        """How many code points from a and from b on (``back``: before a and before b) are equal, ``limit`` at most: by
        binary search."""
        low, high = np.zeros(len(a), np.int64), np.array(limit, np.int64)
        live = np.flatnonzero(low < high)
        while len(live):
            mid = (low[live] + high[live] + 1) // 2
            x, y = (a[live] - mid, b[live] - mid) if back else (a[live], b[live])
            same = self.span(x, mid) == self.span(y, mid)
            low[live], high[live] = np.where(same, mid, low[live]), np.where(same, high[live], mid - 1)
            live = live[low[live] < high[live]]
        return low


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    where = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), where


def fingerprints(hashes: PrefixHashes, where: np.ndarray) -> tuple[list[str], list[np.ndarray], list[np.ndarray]]:
    """Fingerprints of the texts that begin at ``where``, their least span hashes (rising), and where in the text each stands
    first."""
    whole = hashes.span(where[:-1], np.diff(where))
    spans = W.mix(hashes.spans(SPAN)) >> U(16)
    names, least, places = [], [], []
    for n, (a, b) in enumerate(zip(where[:-1].tolist(), where[1:].tolist(), strict=True)):
        own = spans[a : b - SPAN + 1] if b - a >= SPAN else W.mix(whole[n : n + 1]) >> U(16) if b > a else spans[:0]
        small = np.arange(len(own))
        if len(own) > 8 * KEPT:
            small = np.argpartition(own, 4 * KEPT)[: 4 * KEPT]
            small = np.flatnonzero(own <= own[small].max())
        few, at = np.unique(own[small], return_index=True)
        if len(few) < KEPT and len(small) < len(own):
            few, at = np.unique(own, return_index=True)
            small = np.arange(len(own))
        few, at = few[:KEPT], small[at[:KEPT]]
        least.append(few)
        places.append(at)
        names.append(f"{b - a:x}-{int(whole[n]):016x}-{few.astype('>u8').tobytes().hex()}-{at.astype('>u4').tobytes().hex()}")
    return names, least, places


def likenesses(hashes: PrefixHashes, where: np.ndarray, prints: tuple[list[str], list[np.ndarray], list[np.ndarray]], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the texts x[n] and y[n] by their fingerprints and prefix arrays."""
    names, least, places = prints
    pair, a, b = [], [], []
    for n, (i, j) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        if names[i] != names[j]:
            _, p, q = np.intersect1d(least[i], least[j], assume_unique=True, return_indices=True)
            pair.append(np.full(len(p), n))
            a.append(places[i][p])
            b.append(places[j][q])
    out = np.array([names[i] == names[j] for i, j in zip(x.tolist(), y.tolist(), strict=True)], float)
    pair, a, b = (np.concatenate([np.zeros(0, np.int64), *v]).astype(np.int64) for v in (pair, a, b))
    size, begin = np.diff(where), where[:-1]
    of_a, of_b = x[pair], y[pair]
    right = hashes.extension(begin[of_a] + a, begin[of_b] + b, np.minimum(size[of_a] - a, size[of_b] - b))
    left = hashes.extension(begin[of_a] + a, begin[of_b] + b, np.minimum(a, b), back=True)
    covered = _covered(pair, a - left, a + right, len(x)) + _covered(pair, b - left, b + right, len(x))
    both = size[x] + size[y]
    return np.where(out > 0, 1.0, covered / np.maximum(both, 1))


def _covered(pair: np.ndarray, lo: np.ndarray, hi: np.ndarray, count: int) -> np.ndarray:
    """For each pair how much its stretches cover together."""
    order = np.lexsort((lo, pair))
    pair, lo, hi = pair[order], lo[order], hi[order]
    # the farthest end before each stretch, within its pair
    far = np.maximum.accumulate(hi + (pair << 33)) if len(pair) else hi
    before = np.where(np.concatenate([[False], pair[1:] == pair[:-1]])[: len(pair)], np.concatenate([[0], far[:-1]])[: len(pair)] - (pair << 33), 0)
    return np.bincount(pair, np.maximum(0, hi - np.maximum(lo, before)), count)


_OWN = pa.schema([("range", pa.int32()), ("extra", pa.int32()), ("id", pa.int64()), ("key", pa.int64()), ("text", pa.string())])
_OWN_DDL = "range int, extra int, id bigint, key bigint, text string"


def _ranges(ids: np.ndarray, keys: np.ndarray, cuts: np.ndarray, key_cuts: np.ndarray) -> np.ndarray:
    """Ranges count from the largest ids down; after those of ids come those of null ids, from the largest keys down."""
    by_id = len(cuts) - np.searchsorted(cuts, ids, "left")
    by_key = len(cuts) + 1 + len(key_cuts) - np.searchsorted(key_cuts, keys, "left")
    return np.where(ids == NO_ID, by_key, by_id).astype(np.int32)


def _own(cuts: np.ndarray, key_cuts: np.ndarray, heads: dict[int, tuple[int, int]]):
    """Each document with its range, numbered without empty ones; a range's first also at the end of the range before."""
    number = np.zeros(max(heads, default=0) + 1, np.int32)
    number[sorted(heads)] = np.arange(len(heads))
    first = [heads[r] for r in sorted(heads)]

    def run(batches):
        for batch in batches:
            ids, keys = np.asarray(batch.column("id")), np.asarray(batch.column("key"))
            of = number[_ranges(ids, keys, cuts, key_cuts)]
            again = np.flatnonzero([first[r] == (i, k) for r, i, k in zip(of.tolist(), ids.tolist(), keys.tolist(), strict=True)])
            for extra, rows, ranges in ((0, batch, of), (1, batch.take(pa.array(again)), (of[again] - 1) % len(first))):
                if len(ranges):
                    yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(np.full(len(ranges), extra, np.int32)), rows.column("id"), rows.column("key"), rows.column("text").cast(pa.string())], schema=_OWN)

    return run


def _beside(batches):
    """Each document beside the next of its sorted range."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("common_start", pa.int64())])

    def compared(pairs):
        texts = [p[0][2] for p in pairs]
        edited = [t[: len(t) - len(t) // 2] + n[2][: len(t) // 2] for t, (_, n) in zip(texts, pairs, strict=True)]
        k = len(pairs)
        # the next document is mostly the one of the next pair; the others are fingerprinted besides
        ends = [n for n in range(k) if n + 1 == k or pairs[n][1] is not pairs[n + 1][0]]
        points, where = _points(texts + edited + [pairs[n][1][2] for n in ends])
        hashes = PrefixHashes(points)
        prints = fingerprints(hashes, where)
        own, other, following = np.arange(k), np.arange(k) + k, np.arange(k) + 1
        following[ends] = 2 * k + np.arange(len(ends))
        common = hashes.extension(where[own], where[other], np.minimum(np.diff(where)[own], np.diff(where)[other]))
        near = likenesses(hashes, where, prints, np.concatenate([own, own]), np.concatenate([other, following]))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([p[0][1] if p[0][1] != NO_ID else None for p in pairs], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
                pa.array(prints[0][:k]),
                pa.array(prints[0][k : 2 * k]),
                pa.array(near[:k]),
                pa.array(near[k:]),
                pa.array(common),
            ],
            schema=schema,
        )

    last, pairs, size = None, [], 0
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("range", "id", "text", "extra"))
        for row in zip(*columns, strict=True):
            if last is not None and last[0] == row[0] and not last[3]:
                pairs.append((last, row))
                size += len(last[2])
                if size >= BLOCK // 2:
                    yield compared(pairs)
                    pairs, size = [], 0
            last = row
    if pairs:
        yield compared(pairs)


_BESIDE_DDL = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_start bigint"


def compare_neighbours(documents: DataFrame) -> DataFrame:
    """Per row of ``documents``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, common_start (code points before text and edited text first differ).

    The edited text has the first floor(n_chars / 2) code points of the next document, or all of them, in place
    of as many last ones.
    """
    spark = documents.sparkSession
    prepare(spark)
    text = F.coalesce("text", F.lit(""))
    docs = documents.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    size, null = docs.agg(F.sum(F.octet_length("text")), F.avg((F.col("id") == NO_ID).cast("int"))).first()
    parts = int(np.clip((size or 0) // RANGE_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_RANGES))
    shares = [k / parts for k in range(1, parts)]
    cuts, key_cuts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if shares:
        at = lambda c: F.percentile_approx(c, F.array(*map(F.lit, shares)), 10 * parts)
        by_id, by_key = docs.agg(at(F.when(F.col("id") != NO_ID, F.col("id"))), at(F.when(F.col("id") == NO_ID, F.col("key")))).first()
        cuts, key_cuts = np.unique(np.array(by_id or [], np.int64)), np.unique(np.array(by_key if null and null * parts > 1 else [], np.int64))

    def slim(batches):
        for batch in batches:
            of = _ranges(np.asarray(batch.column("id")), np.asarray(batch.column("key")), cuts, key_cuts)
            yield pa.RecordBatch.from_arrays([pa.array(of), batch.column("id"), batch.column("key")], names=["range", "id", "key"])

    first = docs.select("id", "key").mapInArrow(slim, "range int, id bigint, key bigint").groupBy("range").agg(F.max(F.struct("id", "key")).alias("h"))
    heads = {r.range: (r.h.id, r.h.key) for r in first.collect()}
    if not heads:
        return spark.createDataFrame([], _BESIDE_DDL)
    own = docs.mapInArrow(_own(cuts, key_cuts, heads), _OWN_DDL)
    ordered = own.repartitionById(len(heads), F.col("range")).sortWithinPartitions("range", "extra", F.col("id").desc(), F.col("key").desc())
    return ordered.mapInArrow(_beside, _BESIDE_DDL)
