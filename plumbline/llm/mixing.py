"""Mixing sources to target weights by systematic sampling, in DataFrame operations alone.

Targets: the sources share 100 % of all words by weight, none above ``most`` times its own words; the excess
is shared again by weight until none is above.  That is one water level over the sources in order of the
level at which each is full, so it needs one running sum over a row per source.

Sampling: with r = target / words of the source, every document is expected r times.  The documents of a source, in the order
of a hash, are prefix-summed (each adds r), one random offset is added, and a document is emitted once per integer
boundary that its expected copies cross.  Of ``OFFSETS`` offsets, evenly spaced from a random first, each source takes that
whose total is nearest its target.  (In order of size the total would be off by the largest document at most, but
offsets would hardly change it: on 1,000 and 10,000 documents from 20 sources the worst source is off by 10.6 % and 6.7 % so,
by 6.8 % and 1.0 % in the order of a hash.)

Scale: prefix sums run in two levels.  Rows are dealt by (source, hash of the row) and counted there; the counts,
a row per source and bucket, are prefix-summed by source; so a source with a third of all rows is spread over
all its buckets.  Only ids, sizes and hashes are shuffled.  Targets take a row a source.

Defined results: null text has no words; a null source is a source of its own, last in order; rows equal in
id, source and size are interchangeable; a source without words has target 0; an empty table gives an empty
result.  Reruns agree, whatever the partitions: order and offset depend on the rows and ``seed`` alone.  Further
columns, of any name, stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import beside, few, fresh, own
from .scratch import table

#: Rows of a bucket, at most, when hashes are even.
BUCKET_ROWS = 20_000
#: Offsets that a source chooses from.
OFFSETS = 32
WORD = r"[^\x20\x09-\x0D]+"


def _size():
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")


def _digits(text):
    """32 bits of a hash that any SQL engine has."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def sized(documents: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text)."""
    return documents.select("doc_id", F.col("source").cast("string").alias("source"), _size().alias("size"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """From (source, source_size): source, source_size, weight, target."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    full = F.col("source_size") * F.lit(float(most)) / F.col("weight")
    ranked = weighed.withColumn("n", F.row_number().over(Window.orderBy(full, F.col("source").asc_nulls_last())))
    before = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("n").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    levels = ranked.withColumn("level", left / F.sum("weight").over(onward)).withColumn("is_full", F.col("source_size") * F.lit(float(most)) <= F.col("level") * F.col("weight"))
    # sources fill up in this order: those after the first that is not full share its level
    level = F.min(F.when(~F.col("is_full"), F.struct("n", "level"))).over(every)
    cap = F.col("source_size") * F.lit(float(most))
    shared = F.when(level.isNull() | (F.col("n") < level["n"]), cap).otherwise(F.least(cap, level["level"] * F.col("weight")))
    return levels.select("source", "source_size", "weight", shared.cast("double").alias("target"))


def mix(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 7) -> DataFrame:
    """Per row of ``documents``: doc_id, source, size, source_size, target, copies, and taken, the words that the mix takes,
    repeats counted."""
    # sizes are used more than once: texts are read once, for a slim table
    return sample(table(sized(documents), "sizes"), weights, most, seed)


def sample(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 7, extra: tuple[str, ...] = ()) -> DataFrame:
    """As ``mix``, from (doc_id, source, size, *extra); ``extra`` tells rows equal in id and size apart."""
    buckets = max(256, -(-rows.count() // BUCKET_ROWS))
    bucket = _digits(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size")) % buckets
    keyed = rows.select(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("s_null"), bucket.alias("bucket"), "doc_id", "source", "size", *extra)
    source, key = ["s", "s_null"], ["s", "s_null", "bucket"]
    groups = table(keyed.groupBy(*key).agg(F.first("source").alias("source"), F.count("*").alias("n"), F.sum("size").alias("words")), "groups")
    goal = targets(groups.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goal.select(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("s_null"), "source_size", "target", ratio.alias("ratio"))
    goal = goal.withColumn("first", _digits(F.concat_ws(":", F.lit(seed), F.col("s_null").cast("int"), "s")) / F.lit(float(1 << 32)))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*source).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = groups.select(*key, before.alias("before")).join(goal, source)
    within = F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "size", *extra))
    placed = table(keyed.withColumn("place", within).join(base, key).withColumn("upto", F.col("before") + F.col("place")), "placed")

    def copies(k: Column | int) -> Column:
        """With the k-th offset."""
        offset = (F.col("first") + k / F.lit(float(OFFSETS))) % F.lit(1.0)
        crossed = F.floor(F.col("upto") * F.col("ratio") + offset) - F.floor((F.col("upto") - 1) * F.col("ratio") + offset)
        return F.least(crossed, F.lit(most)).cast("bigint")

    totals = placed.groupBy(*source).agg(F.max("target").alias("goal"), *(F.sum(copies(F.lit(k)) * F.col("size")).alias(f"t{k}") for k in range(OFFSETS)))
    nearest = F.array_min(F.array(*(F.struct(F.abs(F.col(f"t{k}") - F.col("goal")).alias("off"), F.lit(k).alias("k")) for k in range(OFFSETS))))["k"]
    # a row a source: broadcast where there are few
    chosen = totals.select(*source, nearest.alias("k"))
    taken = placed.join(F.broadcast(chosen) if few(chosen) else chosen, source).withColumn("copies", copies(F.col("k")))
    return taken.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *extra)


def repeated(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 7) -> DataFrame:
    """``documents`` with each row as often as the mix takes it, which may be not at all."""
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    key = text.bitwiseAND(F.lit(-2)).bitwiseOR(F.col("doc_id").isNull().cast("bigint"))  # the last bit tells null ids
    rows = table(documents.select("doc_id", F.col("source").cast("string").alias("source"), _size().alias("size"), key.alias("key")), "sizes")
    drawn = sample(rows, weights, most, seed, ("key",))
    marked, names = beside(documents, id=F.coalesce(F.col("doc_id").cast("string"), F.lit("")), key=key)
    on = list(names.values())
    taken = drawn.groupBy(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(on[0]), F.col("key").alias(on[1])).agg(F.sum("copies").alias(times := fresh(marked, "__times")), F.count("*").alias(alike := fresh(marked, "__alike")))
    taken = table(taken.where(F.col(times) > 0), "taken")
    # texts are shuffled only where the list of ids is too long to be sent to every executor
    out = marked.join(F.broadcast(taken) if few(taken) else taken, on)
    # rows equal in id and text share their copies, the first of them any that are over
    if not taken.where(F.col(alike) > 1).isEmpty():
        place = F.row_number().over(Window.partitionBy(*on).orderBy("source"))
        share = F.floor(F.col(times) / F.col(alike)) + (place <= F.col(times) % F.col(alike)).cast("bigint")
        out = out.where(F.col(alike) == 1).unionByName(out.where(F.col(alike) > 1).withColumn(times, share))
    return out.where(F.col(times) > 0).select(*own(documents), F.explode(F.sequence(F.lit(1).cast("bigint"), times)).alias(fresh(documents, "__copy"))).select(*own(documents))
