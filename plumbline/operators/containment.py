"""Which texts hold which gold texts whole, upper and lower case alike.

Golds of up to ``GOLD_BYTES`` go to every task, where one scan of a text looks for all of them: an Aho-Corasick automaton over
a short piece of each gold, that of its start, middle and end which fewest golds share, tells where a gold may stand, and the
text itself is compared there.  So the automaton has ``PIECE`` nodes a gold at most, however long it is, and no text is shuffled.

Larger sets of golds are joined: the inner words of a gold are whole words of any text that holds it, so the first ``k`` of them (fewer
in short golds) are looked up among the runs of words of each document, by hash, and only what meets is compared.  Golds of two words or
less have no inner words; they are few kinds of text, and those that fit are scanned for, in several scans if need be.

Null and empty golds are in no text; texts are lower-cased by Spark on both sides.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GOLD_BYTES = 16 << 20
PIECE = 16


def pieces(golds: list[str]) -> list[tuple[str, int]]:
    """For each gold the piece that fewest golds share, and where it stands in the gold."""
    at = [sorted({0, max(0, (len(g) - PIECE) // 2), max(0, len(g) - PIECE)}) for g in golds]
    shared = Counter(g[a : a + PIECE] for g, places in zip(golds, at, strict=True) for a in places)
    out = []
    for g, places in zip(golds, at, strict=True):
        best = min(places, key=lambda a: (shared[g[a : a + PIECE]], a))
        out.append((g[best : best + PIECE], best))
    return out


def _scanned(golds, document: str):
    """(document, number of a gold) of each gold that a text holds; ``golds`` is a broadcast list of distinct texts."""

    def run(batches):
        import ahocorasick

        known = golds.value
        held: dict[str, list[tuple[int, int]]] = {}
        for n, (piece, at) in enumerate(pieces(known)):
            held.setdefault(piece, []).append((n, at))
        automaton = ahocorasick.Automaton()
        for piece, those in held.items():
            automaton.add_word(piece, (len(piece), those))
        if held:
            automaton.make_automaton()
        for batch in batches:
            docs, found = [], []
            for row, text in enumerate(batch.column("__t").to_pylist()):
                if text is None:
                    continue
                hits = set()
                for end, (size, those) in automaton.iter(text) if held else ():
                    for n, at in those:
                        start = end + 1 - size - at
                        if n not in hits and start >= 0 and text.startswith(known[n], start):
                            hits.add(n)
                docs += [row] * len(hits)
                found += sorted(hits)
            yield pa.RecordBatch.from_arrays([batch.column(document).take(pa.array(docs, pa.int64())), pa.array(found, pa.int64())], names=[document, "__n"])

    return run


def _scan(documents: DataFrame, golds: DataFrame, document: str, gold: str, text: str) -> DataFrame:
    """Golds (gold, __gold) that are few: one scan of the documents."""
    numbered = golds.groupBy("__gold").agg(F.collect_list(gold).alias("__ids")).collect()  # below GOLD_BYTES
    spark = documents.sparkSession
    kind = golds.schema[gold].dataType
    sent = spark.sparkContext.broadcast([r["__gold"] for r in numbered])
    rows = documents.select(document, F.lower(text).alias("__t"))
    hits = rows.mapInArrow(_scanned(sent, document), f"`{document}` {rows.schema[document].dataType.simpleString()}, __n bigint")
    ids = spark.createDataFrame([(n, r["__ids"]) for n, r in enumerate(numbered)], f"__n bigint, __ids array<{kind.simpleString()}>")
    return hits.join(F.broadcast(ids), "__n").select(document, F.explode("__ids").alias(gold))


def words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[\x00-\x20]+", " ")), " ")


def _runs(held: str, size: int) -> Column:
    """Hashes of all runs of ``size`` words of an array."""
    return F.transform(F.sequence(F.lit(1), F.size(held) - size + 1), lambda i: F.xxhash64(F.array_join(F.slice(held, i, F.lit(size)), " ")))


def _joined(documents: DataFrame, golds: DataFrame, document: str, gold: str, text: str, k: int) -> DataFrame:
    """Golds of three words or more, by their inner words."""
    inner = golds.withColumn("__w", words(F.col("__gold"))).withColumn("__w", F.slice("__w", 2, F.greatest(F.size("__w") - 2, F.lit(0))))
    keyed = inner.withColumn("__k", F.least(F.size("__w"), F.lit(k))).withColumn("__key", F.xxhash64(F.array_join(F.slice("__w", F.lit(1), "__k"), " ")))
    found = None
    for size in range(1, k + 1):
        some = keyed.where(F.col("__k") == size)
        held = documents.select(document, words(F.col(text)).alias("__w")).where(F.size("__w") >= size)
        pairs = held.select(document, F.explode(F.array_distinct(_runs("__w", size))).alias("__key")).join(some.select("__key", gold), "__key").select(document, gold).distinct()
        hit = documents.select(document, F.lower(text).alias("__t")).join(pairs.join(some.select(gold, "__gold"), gold), document).where(F.contains("__t", "__gold")).select(document, gold)
        found = hit if found is None else found.unionByName(hit)
    return found


def containing(documents: DataFrame, golds: DataFrame, document: str, gold: str, text: str = "text", k: int = 4) -> DataFrame:
    """(document, gold) of documents whose text holds a gold text whole; ids of documents are taken to be unique, and not null."""
    g = golds.select(gold, F.lower(text).alias("__gold")).where("__gold != ''")
    if (g.agg(F.sum(F.octet_length("__gold"))).first()[0] or 0) <= GOLD_BYTES:
        return _scan(documents, g, document, gold, text)
    short = g.where(F.size(words(F.col("__gold"))) <= 2)
    size = short.agg(F.sum(F.octet_length("__gold"))).first()[0] or 0
    out = _joined(documents, g.where(F.size(words(F.col("__gold"))) > 2), document, gold, text, k)
    parts = max(1, -(-2 * size // GOLD_BYTES))
    for n in range(parts):
        out = out.unionByName(_scan(documents, short.where(F.pmod(F.xxhash64("__gold"), F.lit(parts)) == n), document, gold, text))
    return out
