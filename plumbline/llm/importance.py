"""Importance resampling towards the word statistics of a target table.

1. Every feature (a run of one word or more) falls into a bucket by its crc32.  Each task sums its counts into one array and
   sends a row for each bucket that it has, so the shuffle holds at most ``buckets`` rows a task.
2. The gain of a bucket is the logarithm of its share in the target over its share in the documents, in thousandths.  The
   gains are an array of ``buckets`` numbers, sent with the tasks, whatever the size of the corpus.
3. A second scan scores each document: the mean gain of its features, and a Gumbel noise that its id alone decides, so the
   documents with the highest sums are a sample without replacement in proportion to the weights.
4. Distributed radix selection finds the k-th key: the key (score from above, then id) is cut into digits of 16 bits; one
   aggregate counts the rows by the first digit, the next one by the second digit of those rows that agree with the k-th key
   so far, and so on.  A pass sends 65,536 counts at most to the driver and reads fewer rows than the one before.
5. Only rows up to the k-th key are shuffled: dealt by ranges of the key, sorted, and ranked by their place in the partition
   and the counts of the partitions before it.

Defined results: a null text has no words; a null id gives the noise of the empty text and comes after all others; rows that
are equal in id and score are ranked by their number of features, and equal ones in any order; documents with too few words are
scored and never drawn; an empty table gives an empty result, and an empty target counts as no features at all.  Only
doc_id and text are read, so further columns do no harm.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordblocks as W
from .scratch import prepare, table

DIGIT = 16
#: Longer words are hashed one by one; the others byte place by byte place, all words at once.
LONGEST = 64
#: Words that are hashed at a time.
SLICE = 1 << 17

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (c & np.uint32(1)))
    return c


_TABLE = _crc_table()


def crc_states(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The crc32 register of each row after the bytes of its range; the register begins with all bits set."""
    out, size = state.copy(), ends - starts
    for n in np.flatnonzero(size > LONGEST):
        out[n] = zlib.crc32(data[starts[n] : ends[n]].tobytes(), int(out[n]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    live = np.flatnonzero(size <= LONGEST)
    live = live[np.argsort(-size[live], kind="stable")]
    left = np.searchsorted(-size[live], -np.arange(size[live].max(initial=0)), "left")  # how many are longer than each place
    for place, count in enumerate(left):
        some = live[:count]
        out[some] = _TABLE[(out[some] ^ data[starts[some] + place]) & np.uint32(255)] ^ (out[some] >> np.uint32(8))
    return out


def features(data: np.ndarray, where: np.ndarray, longest: int, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The buckets of runs of one word, of two words, up to ``longest``: words in a run, bucket of the run from each word on (-1
    where the text ends before), and each text's first word."""
    data = W.LOWER[data]
    starts, ends, first = W.runs(_WORD[data], where)
    last = np.repeat(first[1:], np.diff(first))  # the end of the text of each word
    state = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    for n in range(longest):
        there = np.flatnonzero(np.arange(len(starts)) + n < last)
        for lo in range(0, len(there), SLICE):
            some = there[lo : lo + SLICE]
            now = state[some]
            if n:  # one space
                now = _TABLE[(now ^ np.uint32(0x20)) & np.uint32(255)] ^ (now >> np.uint32(8))
            state[some] = crc_states(now, data, starts[some + n], ends[some + n])
        found = np.full(len(starts), -1, np.int32)
        found[there] = (~state[there] % np.uint32(buckets)).astype(np.int32)
        yield n + 1, found, first


def _counted(longest: int, buckets: int):
    """A partition's features by bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, where = W.utf8(batch.column("text"))
            for _, _, part, at in W.blocks(data, where):
                for _, found, _ in features(part, at, longest, buckets):
                    total += np.bincount(found[found >= 0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, longest: int = 1, buckets: int = 10_000) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    found = texts.select("text").mapInArrow(_counted(longest, buckets), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for row in found:
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, the thousandfold logarithm of its share in the target over its share in the source, each count one up."""
    size, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weighed(gain: np.ndarray, longest: int):
    def run(batches):
        for batch in batches:
            data, where = W.utf8(batch.column("text"))
            count, words, weight = (np.zeros(len(batch), np.int64) for _ in range(3))
            for lo, hi, part, at in W.blocks(data, where):
                total = np.zeros(hi - lo, np.int64)
                for n, found, first in features(part, at, longest, len(gain)):
                    upto = np.concatenate([[0], np.cumsum(np.where(found >= 0, gain[found], 0))])
                    total += upto[first[1:]] - upto[first[:-1]]
                    count[lo:hi] += np.maximum(np.diff(first) - n + 1, 0)
                    if n == 1:
                        words[lo:hi] = np.diff(first)
                weight[lo:hi] = total // np.maximum(count[lo:hi], 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (count, words, weight))], names=["doc_id", "n_features", "n_words", "weight"])

    return run


def scored(documents: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, n_features, n_words, weight, score; ``target`` has a column text."""
    prepare(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    weighed = docs.mapInArrow(_weighed(gain, longest), "doc_id bigint, n_features bigint, n_words bigint, weight bigint")
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    uniform = (F.conv(F.substring(digits, 1, 8), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(4294967296.0)
    return weighed.withColumn("score", F.col("weight") + F.floor(F.lit(-1000) * F.log(-F.log(uniform))))


def _digits(value: Column, least: int, most: int) -> list[Column]:
    """``value`` - ``least``, which is at most ``most`` - ``least``, as digits, the highest first.  The difference of two ids may
    take all 64 bits, so both are shifted as unsigned numbers with the sign bit turned: then it needs no subtraction."""
    width = (most - least).bit_length()
    if width < 63:
        return [F.shiftright(value - F.lit(least), DIGIT * n).bitwiseAND(F.lit((1 << DIGIT) - 1)).cast("int") for n in reversed(range(max(1, -(-width // DIGIT))))]
    turned = value.bitwiseXOR(F.lit(-(1 << 63)))
    return [F.shiftrightunsigned(turned, DIGIT * n).bitwiseAND(F.lit((1 << DIGIT) - 1)).cast("int") for n in reversed(range(64 // DIGIT))]


def _key(rows: DataFrame) -> tuple[list[Column], int]:
    """The digits of a row's place in the order of draws, the best first, and the number of rows."""
    ends = rows.agg(F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).first()
    if not ends.n:
        return [], 0
    first, last = (ends.first, ends.last) if ends.first is not None else (0, 0)
    below = _digits(-F.col("score"), -ends.hi, -ends.lo)
    ids = [F.coalesce(d, F.lit(0)) for d in _digits(F.col("doc_id"), first, last)]
    return [*below, F.col("doc_id").isNull().cast("int"), *ids], ends.n


def kth_key(rows: DataFrame, digits: list[Column], k: int) -> list[int]:
    """The first digits of the k-th least key of ``rows``, up to where all rows with them are among the k least; all its digits if
    the k-th key is held by more rows than that.  ``k`` is 1 at least and at most the number of rows."""
    found: list[int] = []
    for n, digit in enumerate(digits):
        alike = rows.where(F.lit(True) if not found else F.struct(*digits[:n]) == F.struct(*(F.lit(x) for x in found)))
        counts = alike.groupBy(digit.alias("digit")).count().collect()  # 65,536 at most
        for row in sorted(counts, key=lambda r: r.digit):
            if row["count"] >= k:
                break
            k -= row["count"]
        found.append(row.digit)
        if row["count"] == k:
            break
    return found


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with rank, 1 for the first in ``order``: by ranges, without gathering them."""
    # equal rows are told apart by a number, so that a range can end between them
    salted = rows.withColumn("salt", F.monotonically_increasing_id())
    placed = table(salted.repartitionByRange(*order, F.col("salt")).sortWithinPartitions(*order, F.col("salt")).drop("salt").withColumn("place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftrightunsigned("place", 33)
    before, offsets = 0, []
    for row in sorted(placed.groupBy(part.alias("part")).count().collect()):  # a row a partition
        offsets.append((row.part, before))
        before += row["count"]
    spark = rows.sparkSession
    starts = spark.createDataFrame(offsets, "part bigint, before bigint")
    within = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", F.col("before") + within + 1).drop("part", "before", "place")


def resample(documents: DataFrame, target: DataFrame, share: tuple[int, int] = (10, 100), least_words: int = 20, longest: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """Per row of ``documents``: doc_id, n_features, n_words, weight, score, and rank, null where it is not drawn.

    Of the documents with ``least_words`` words, share[0] / share[1] are drawn, rounded down."""
    rows = table(scored(documents, target, longest, buckets, seed), "scored")
    able = rows.where(F.col("n_words") >= least_words)
    digits, n = _key(able)
    k = n * share[0] // share[1]
    if not k:
        return rows.withColumn("rank", F.lit(None).cast("bigint"))
    found = kth_key(able, digits, k)
    drawn = (F.col("n_words") >= least_words) & (F.struct(*digits[: len(found)]) <= F.struct(*(F.lit(x) for x in found)))
    best = ranked(rows.where(drawn), [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features")])
    # rows that share the k-th key may be more than are drawn
    best = best.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return rows.where(~drawn).withColumn("rank", F.lit(None).cast("bigint")).unionByName(best)
