"""Packing token sequences by minimum bin slack.

Documents are cut at every ``capacity`` ids; the rests form a histogram of at most ``capacity`` lengths, however
large the corpus.  The driver plans on that histogram alone: for the longest rest left, a bitset subset-sum
dynamic programme finds the multiset of other rests that comes nearest to filling its window, backtracking
gives the counts, and the pattern is used as often as the counts allow.  Where the best pattern leaves a gap,
the start of one more rest is cut off to fill it.  What cannot fill a last window is laid out in windows
of powers of two, which need no padding.

The plan says for each range of ranks within a length which sequences and offsets it gets.  Ranks come from
counts by (length, hash bucket), prefix-summed, and a numbering within each of these; so a length that a third
of all documents share is spread over all buckets.  Texts are not shuffled.  Documents whose rests the plan cuts are
tokenized again, for the hashes of the parts; where these are more than ``FEW``, their texts alone are shuffled.

Defined results: null text is the empty text, which is the final id alone; rows that repeat an id are packed as
documents of their own; an empty table gives an empty result; an id of null stays null.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wordblocks as W
from .bpe import ByteBpe
from .frames import FEW, few
from .scratch import prepare, table

CAPACITY = 2048
END_ID = 1
#: Pieces of a bucket, at most, when hashes are even.
BUCKET_ROWS = 20_000

_PIECES = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64()), ("doc_tokens", pa.int64())])
_PIECES_DDL = "doc_id bigint, key bigint, start bigint, length bigint, crc bigint, doc_tokens bigint"


def _token_ids(column, path: str, end_id: int):
    """Runs of texts: first, end, all ids with the final one, and where each text's begin."""
    bpe = ByteBpe.load(path)
    data, where = W.utf8(column)
    for lo, hi, part, at in W.blocks(data, where):
        ids, begin = bpe.encode(part, at)
        yield lo, hi, np.insert(ids, begin[1:], end_id).astype("<i4"), begin + np.arange(len(begin))


def _cut(path: str, capacity: int, end_id: int):
    def run(batches):
        for batch in batches:
            for lo, hi, ids, begin in _token_ids(batch.column("text"), path, end_id):
                size = np.diff(begin)
                count = -(-size // capacity)
                doc = np.repeat(np.arange(hi - lo), count)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * capacity
                length = np.minimum(capacity, size[doc] - start)
                raw, at = memoryview(ids.tobytes()), (begin[doc] + start) * 4
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
                rows = batch.slice(lo, hi - lo)
                of = pa.array(doc)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(of), rows.column("key").take(of), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(size[doc])], schema=_PIECES)

    return run


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within ``counts``, whose sum comes nearest to ``room`` from below."""
    bits, mask, steps = 1, (1 << room + 1) - 1, []
    for length in sorted((x for x in counts if 0 < x <= room and counts[x] > 0), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left and not bits >> room & 1:
            part = min(part, left)
            steps.append((length, part, bits))
            bits |= bits << length * part & mask
            left, part = left - part, part * 2
        if bits >> room & 1:
            break
    at, used = bits.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + part
            at -= length * part
    return used


class Plan:
    """Entries (layer, length, first rank, count, offset in the piece, ids taken, first sequence, offset in it).

    Layer j has the j-th parts of pieces; within a layer and length the ranges of ranks do not overlap.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.entries, self.sequences = capacity, [], 0
        self.counts = {x: int(n) for x, n in counts.items() if n}
        # for each length of what is left: runs of (original length, first rank, count, offset, layer)
        self.runs = {x: [(x, 0, n, 0, 0)] for x, n in self.counts.items()}
        while self.counts:
            if sum(x * n for x, n in self.counts.items()) < capacity or not self._window():
                self._rest()

    def _take(self, length: int, many: int, size: int, sequence: int, offset: int) -> None:
        """The first ``size`` ids of ``many`` pieces, one for each sequence from ``sequence`` on."""
        self.counts[length] -= many
        if not self.counts[length]:
            del self.counts[length]
        while many:
            original, rank, count, at, layer = self.runs[length].pop()
            use = min(count, many)
            if use < count:
                self.runs[length].append((original, rank + use, count - use, at, layer))
            self.entries.append((layer, original, rank, use, at, size, sequence, offset))
            if size < length:
                self.runs.setdefault(length - size, []).append((original, rank, use, at + size, layer + 1))
                self.counts[length - size] = self.counts.get(length - size, 0) + use
            many, sequence = many - use, sequence + use

    def _window(self) -> bool:
        top = max(self.counts)
        rest = {x: n - (x == top) for x, n in self.counts.items()}
        used = best_fill(rest, self.capacity - top)
        gap = self.capacity - top - sum(x * n for x, n in used.items())
        used[top] = used.get(top, 0) + 1
        cut = max((x for x, n in self.counts.items() if x > gap and n > used.get(x, 0)), default=0) if gap else 0
        if gap and not cut:
            return False
        times = min(self.counts[x] // (n + (x == cut)) for x, n in (used | ({} if cut in used else {cut: 0} if cut else {})).items())
        sequence, offset = self.sequences, 0
        self.sequences += times
        for x in sorted(used, reverse=True):
            for _ in range(used[x]):
                self._take(x, times, x, sequence, offset)
                offset += x
        if gap:
            self._take(cut, times, gap, sequence, offset)
        return True

    def _rest(self) -> None:
        """Less than a window, or what no pattern fills: windows of powers of two, largest first."""
        total = sum(x * n for x, n in self.counts.items())
        while total:
            room = min(self.capacity, 1 << total.bit_length() - 1)
            total -= room
            offset = 0
            while offset < room:
                top = max(self.counts)
                size = min(top, room - offset)
                self._take(top, 1, size, self.sequences, offset)
                offset += size
            self.sequences += 1

    def layers(self) -> list[np.ndarray]:
        """For each layer its entries, by length and rank, one column each."""
        rows = np.array(sorted(self.entries), np.int64).reshape(-1, 8)
        return [rows[rows[:, 0] == n, 1:].T for n in np.unique(rows[:, 0])]


_PLACED = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_PLACED_DDL = _PIECES_DDL + ", sequence_id bigint, offset bigint"


def _place(layers: list[np.ndarray]):
    """Adds sequence and offset to pieces that have a rank; the crc of a cut piece is null."""

    def run(batches):
        for batch in batches:
            length, rank, start = (np.asarray(batch.column(c)) for c in ("length", "rank", "start"))
            for own_length, own_rank, count, at, size, sequence, offset in layers:
                entry = np.searchsorted(own_length << 40 | own_rank, length << 40 | rank, "right") - 1
                entry[entry < 0] = 0
                in_it = (own_length[entry] == length) & (rank >= own_rank[entry]) & (rank < own_rank[entry] + count[entry])
                rows = np.flatnonzero(in_it)
                if len(rows):
                    e, of = entry[rows], batch.take(pa.array(rows))
                    crc = pa.array(np.asarray(of.column("crc")), mask=size[e] != length[rows])
                    yield pa.RecordBatch.from_arrays([of.column("doc_id"), of.column("key"), pa.array(start[rows] + at[e]), pa.array(size[e]), crc, of.column("doc_tokens"), pa.array(sequence[e] + rank[rows] - own_rank[e]), pa.array(offset[e])], schema=_PLACED)

    return run


def _crcs(path: str, end_id: int):
    """The crc of each named part of each document."""
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("cut_crc", pa.int64())])

    def run(batches):
        for batch in batches:
            for lo, hi, ids, begin in _token_ids(batch.column("text"), path, end_id):
                rows = batch.slice(lo, hi - lo)
                starts, lengths = rows.column("starts"), rows.column("lengths")
                doc = W.owner(np.concatenate([[0], np.cumsum(np.asarray(starts.value_lengths()))]))
                start, length = np.asarray(starts.flatten()), np.asarray(lengths.flatten())
                raw, at = memoryview(ids.tobytes()), 4 * (begin[doc] + start)
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
                of = pa.array(doc)
                yield pa.RecordBatch.from_arrays([rows.column("id").take(of), rows.column("key").take(of), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], schema=schema)

    return run


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer``: path of a byte-level ``tokenizers`` file that every executor has.
    """
    prepare(documents.sparkSession)
    text = F.coalesce("text", F.lit(""))
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    pieces = table(docs.mapInArrow(_cut(tokenizer, capacity, end_id), _PIECES_DDL), "pieces")
    buckets = max(64, -(-pieces.count() // BUCKET_ROWS))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "key", "start"), F.lit(buckets)))
    counts = table(dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")), "counts")
    plan = Plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    base = F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "key", "start"))
    ranked = dealt.join(counts.select("length", "bucket", base.alias("base")), ["length", "bucket"]).withColumn("rank", F.col("base") + within - 1)
    layers = plan.layers()
    placed = ranked.select("doc_id", "key", "start", "length", "crc", "doc_tokens", "rank").mapInArrow(_place(layers), _PLACED_DDL)
    if len(layers) > 1:
        placed = table(placed, "placed")
        cut = placed.where("crc is null").select("doc_id", "key", "start", "length")
        wanted = cut.distinct().groupBy(F.coalesce("doc_id", F.lit(-1)).alias("id"), "key").agg(F.collect_list("start").alias("starts"), F.collect_list("length").alias("lengths"))
        wanted = table(wanted, "wanted")  # a document has a cut rest or none, so the lists are short
        if few(wanted, FEW):
            wanted = F.broadcast(wanted)
        texts = docs.select(F.coalesce("doc_id", F.lit(-1)).alias("id"), "key", "text").join(wanted, ["id", "key"])
        found = texts.select("id", "key", "text", "starts", "lengths").mapInArrow(_crcs(tokenizer, end_id), "id bigint, key bigint, start bigint, length bigint, cut_crc bigint").distinct()
        filled = placed.where("crc is null").withColumn("id", F.coalesce("doc_id", F.lit(-1))).join(found, ["id", "key", "start", "length"]).select(*[F.col("cut_crc").alias("crc") if c == "crc" else F.col(c) for c in placed.columns])
        placed = placed.where("crc is not null").unionByName(filled)
    return placed.select("doc_id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
