"""Quality rules: counts within each text, and the frequency of its lines across the documents of its host.

A line is what lies between newlines and has a word; normalised, it is its words with A-Z lower-cased.
For each host the distinct texts that hold a line are counted (so that mere copies of a document do not make
its lines frequent).  Lines in more than ``limit`` texts of their host are frequent, and ``cleaned`` removes them; a document
that would lose more than ``most_lost`` percent of its words is depleted and rejected.

Within a text windows and lines count as equal only if their bytes are; across texts a line is known by two independent
64-bit hashes of its normalised words.

Texts are read once; then only hashes move.  Counts are summed before they are shuffled, and lines that are not
above the limit never come back; a line that a large share of all rows has is joined by broadcast.

Defined results: null text has no words (and fails the base rules); a null host is a host of its own; rows that
repeat an id are judged one by one; an empty table gives an empty result; further columns, of any name, stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count as numbers

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordblocks as W
from .frames import beside, column, fresh, join_hot, mapped, named, own
from .scratch import prepare, table

#: Fixed by the rules: the characters that count as symbols.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

_STATS = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), ("key", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("lines", pa.list_(pa.int64())), ("checks", pa.list_(pa.int64())), ("line_words", pa.list_(pa.int64()))])
_STATS_DDL = "doc_id bigint, host string, key bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, lines array<bigint>, checks array<bigint>, line_words array<bigint>"


def _per_text(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask)])[at])


def _again(owner: np.ndarray, hashed: Callable[[int], np.ndarray], same: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each item: whether its owner has an equal one, and whether before it.  ``hashed`` gives the items' hashes by
    seed; where items of one hash are not the ``same``, the next seed is tried."""
    for seed in numbers():
        hashes = hashed(seed)
        order = np.lexsort((np.arange(len(hashes)), hashes, owner))
        equal = (owner[order][1:] == owner[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
        if same(order[1:][equal], order[:-1][equal]).all():
            break
    twice, before = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    before[order[1:]] = equal
    twice[order[1:]] = equal
    twice[order[:-1]] |= equal
    return twice, before


def _lines(part: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each line that has a word: its text, its range without the newline, its words, two hashes of it as normalised."""
    breaks = np.union1d(np.flatnonzero(part == 10) + 1, at[:-1])
    breaks = breaks[breaks <= len(part)]
    line_end = np.append(breaks[1:], len(part))
    line_doc = np.searchsorted(at, breaks, "right") - 1
    line_end = np.where((line_end > breaks) & (line_end <= len(part)) & (part[np.maximum(line_end, 1) - 1] == 10) if len(part) else False, line_end - 1, line_end)
    line_first = np.searchsorted(starts, np.append(breaks, len(part)))
    has = np.diff(line_first) > 0
    count = np.diff(line_first)[has]
    low = W.LOWER[part]
    normal = [W.fold(W.span_hashes(low, starts, ends, seed), count).view(np.int64) for seed in (0, 1)]
    return line_doc[has], breaks[has], line_end[has], count, *normal


def _stats(window: int):
    def run(batches):
        for batch in batches:
            data, where = W.utf8(batch.column("text"))
            for lo, hi, part, at in W.blocks(data, where):
                starts, ends, first = W.words(part, at)
                inside = ~W.SPACE[part]
                # words in windows that occur twice or more
                grams, begin = W.gram_hashes(W.span_hashes(part, starts, ends), first, window)
                doc = W.owner(begin)
                word = W.gathered(first[:-1], np.diff(begin))

                def windows(seed, part=part, starts=starts, ends=ends, first=first, grams=grams):
                    return W.gram_hashes(W.span_hashes(part, starts, ends, seed), first, window)[0] if seed else grams

                def same_windows(a, b, part=part, starts=starts, ends=ends, word=word):
                    x, y = (W.gathered(word[i], np.full(len(i), window)) for i in (a, b))
                    return W.same_spans(part, starts[x], ends[x], starts[y], ends[y])

                twice, _ = _again(doc, windows, same_windows)
                cover = np.zeros(len(starts) + 1, np.int64)
                np.add.at(cover, word[twice], 1)
                np.add.at(cover, word[twice] + window, -1)
                repeat = _per_text(np.cumsum(cover)[:-1] > 0, first)
                # lines: their raw bytes decide repetition in the text, their words frequency across texts
                line_doc, line_start, line_end, count, normal, check = _lines(part, at, starts, ends)

                def raw_lines(seed, part=part, a=line_start, b=line_end):
                    return W.span_hashes(part, a, b, seed)

                def same_lines(x, y, part=part, a=line_start, b=line_end):
                    return W.same_spans(part, a[x], b[x], a[y], b[y])

                _, before = _again(line_doc, raw_lines, same_lines)
                dup = np.bincount(line_doc, before, hi - lo).astype(np.int64)
                bounds = pa.array(np.searchsorted(line_doc, np.arange(hi - lo + 1)).astype(np.int32))
                rows = batch.slice(lo, hi - lo)
                points = (part & 0xC0) != 0x80
                stats = np.diff(first), _per_text(points & inside, at), _per_text(SYMBOLS[part], at), dup, repeat
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (normal, check, count)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("host"), rows.column("key"), *(pa.array(x, pa.int64()) for x in stats), *lists], schema=_STATS)

    return run


def _cut(text_at: int, gone_at: int):
    """Texts without the lines whose hashes are in the last column, which goes."""

    def run(batches):
        for batch in batches:
            data, where = W.utf8(batch.column(text_at))
            gone = batch.column(gone_at).to_pylist()
            out = batch.column(text_at).to_pylist()
            for lo, hi, part, at in W.blocks(data, where):
                if not any(gone[lo:hi]):
                    continue
                starts, ends, _ = W.words(part, at)
                line_doc, line_start, _, _, normal, _ = _lines(part, at, starts, ends)
                breaks = np.concatenate([[0], np.cumsum(part == 10)])
                bounds = np.searchsorted(line_doc, np.arange(hi - lo + 1))
                for n in range(hi - lo):
                    if gone[lo + n]:
                        own = slice(bounds[n], bounds[n + 1])
                        drop = np.isin(normal[own], np.array(gone[lo + n], np.int64))
                        drop = set((breaks[line_start[own][drop]] - breaks[at[n]]).tolist())
                        lines = out[lo + n].split("\n")
                        out[lo + n] = "\n".join(x for k, x in enumerate(lines) if k not in drop)
            columns = [pa.array(out, pa.string()) if n == text_at else batch.column(n) for n in range(gone_at)]
            yield named(columns)

    return run


def _keyed(host: str) -> tuple[Column, Column]:
    """A row's host, null apart from all names, and the hash of its text."""
    return F.concat_ws("", F.when(F.col(host).isNotNull(), "="), F.col(host).cast("string")), F.xxhash64(F.coalesce("text", F.lit("")))


def _judged(documents: DataFrame, host: str, limit: int, most_lost: int, window: int) -> DataFrame:
    """The columns of ``judge``, with host, key and gone, the hashes of the lines above the limit."""
    prepare(documents.sparkSession)
    name, key = _keyed(host)
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), name.alias("host"), F.coalesce("text", F.lit("")).alias("text"), key.alias("key"))
    stats = table(docs.mapInArrow(_stats(window), _STATS_DDL).withColumn("row", F.monotonically_increasing_id()), "stats")
    on = ["host", "line", "check"]
    lines = lambda *columns: stats.select(*columns, F.explode(F.arrays_zip("lines", "checks", "line_words")).alias("l")).select(*columns, F.col("l.lines").alias("line"), F.col("l.checks").alias("check"), F.col("l.line_words").alias("words"))
    held = lines("host", "key").groupBy(*on, "key").agg(F.count("*").alias("rows"))
    counted = held.groupBy(*on).agg(F.count("*").alias("texts"), F.sum("rows").alias("rows"))
    frequent = table(counted.where(F.col("texts") > limit).select(*on, "rows"), "frequent")
    total = stats.agg(F.sum(F.size("lines"))).first()[0] or 0
    lost = join_hot(lines("row", "host"), frequent, on, "rows", total).groupBy("row").agg(F.sum("words").alias("lost"), F.collect_set("line").alias("gone"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = stats.join(lost, "row", "left").withColumn("n_frequent_words", F.coalesce("lost", F.lit(0)).cast("bigint")).withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (100 * F.col("n_frequent_words") <= most_lost * F.col("n_words")))


def judge(documents: DataFrame, host: str = "source", limit: int = 20, most_lost: int = 50, window: int = 5) -> DataFrame:
    """Per row of ``documents``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    n_frequent_words (in lines above the limit) and kept."""
    return _judged(documents, host, limit, most_lost, window).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_frequent_words", "kept")


def cleaned(documents: DataFrame, host: str = "source", limit: int = 20, most_lost: int = 50, window: int = 5) -> DataFrame:
    """The documents that ``judge`` keeps, with lines above the limit removed from text and n_chars (where there is
    one) set to its length.  Other lines, those without words too, stay as they are."""
    name, key = _keyed(host)
    marked, names = beside(documents, host=name, key=key)
    fate = _judged(documents, host, limit, most_lost, window).where("kept").select(F.col("host").alias(names["host"]), F.col("key").alias(names["key"]), F.col("gone").alias(gone := fresh(marked, "__gone")))
    kept = marked.join(fate.dropDuplicates(list(names.values())), list(names.values()))
    at = documents.columns.index("text")
    out = mapped(kept.select(*own(documents), column(gone)), _cut(at, len(documents.columns)), documents.schema)
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return out
