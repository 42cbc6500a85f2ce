"""Corrections for multiplicity in families of any size.

A family's p-values are dealt by range and sorted, so a family of all rows is spread over all partitions.  Its part in a partition is
a block; a block's number of tests, then its largest (Holm) or least (BH) stepped value, are one row each, and a running
sum and extreme over a family's blocks say what stands before or behind each.  Within a block a window does the rest.  No
window runs over a family.

Null and NaN p-values stay out: they count for nothing and have no corrected value.  Equal p-values get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workdir import workdir

_LOWEST, _HIGHEST = Window.unboundedPreceding, Window.unboundedFollowing


def _written(rows: DataFrame) -> DataFrame:
    path = workdir(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _family(keys: list[str]) -> Column:
    """One column for the family, in which null is a value."""
    return F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")


def _stepped(tests: DataFrame, p: str, keys: list[str], wanted: list[tuple]) -> DataFrame:
    """``tests`` with running extremes, each of ``wanted`` as (out, ``step(p, rank, tests of the family)``, from_front): the largest so
    far, or the least from here on.  All share one sort by range.

    What is still to come is a window over the opposite order, not a frame that ends at the last row, for which Spark goes over the
    rest of the block again at each row.
    """
    marked = tests.withColumn("__family", _family(keys)).withColumn("__p", F.when(~F.isnan(p), F.col(p).cast("double")))
    known, rest = marked.where("__p is not null"), marked.where("__p is null")
    # a number tells equal values apart, so that a range can end between them
    order = ["__family", "__p", "__salt"]
    dealt = known.withColumn("__salt", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = _written(dealt.drop("__salt").withColumn("__place", F.monotonically_increasing_id()).withColumn("__block", F.shiftright("__place", 33)))
    block = ["__family", "__block"]
    sizes = placed.groupBy(*block).agg(F.count("*").alias("__n"), F.min("__place").alias("__first"))
    blocks, places = Window.partitionBy("__family"), Window.partitionBy(*block)
    # blocks before this one in the order named, and a block's tests up to this one
    before = {True: blocks.orderBy("__block").rowsBetween(_LOWEST, -1), False: blocks.orderBy(F.desc("__block")).rowsBetween(_LOWEST, -1)}
    upto = {True: places.orderBy("__place").rowsBetween(_LOWEST, Window.currentRow), False: places.orderBy(F.desc("__place")).rowsBetween(_LOWEST, Window.currentRow)}
    extremes = {True: (F.max, F.greatest), False: (F.min, F.least)}
    offsets = sizes.select(*block, "__first", F.coalesce(F.sum("__n").over(before[True]), F.lit(0)).alias("__before"), F.sum("__n").over(blocks).alias("__m"))
    rank = F.col("__before") + F.col("__place") - F.col("__first") + 1
    values = [F.least(F.lit(1.0), step(F.col("__p"), rank, F.col("__m"))).alias(f"__v{k}") for k, (_, step, _) in enumerate(wanted)]
    stepped = placed.join(offsets, block).select(*placed.columns, *values)
    ends = stepped.groupBy(*block).agg(*[extremes[front][0](f"__v{k}").alias(f"__e{k}") for k, (_, _, front) in enumerate(wanted)])
    others = ends.select(*block, *[extremes[front][0](f"__e{k}").over(before[front]).alias(f"__o{k}") for k, (_, _, front) in enumerate(wanted)])
    done = stepped.join(others, block)
    for k, (out, _, front) in enumerate(wanted):
        pick, extreme = extremes[front]
        done = done.withColumn(out, extreme(pick(f"__v{k}").over(upto[front]), F.col(f"__o{k}")))
    columns, outs = [F.col(f"`{c}`") for c in tests.columns], [out for out, _, _ in wanted]
    return done.select(*columns, *outs).unionByName(rest.select(*columns, *[F.lit(None).cast("double").alias(out) for out in outs]))


def _holm(v: Column, i: Column, m: Column) -> Column:
    return (m - i + 1) * v


def _bh(v: Column, i: Column, m: Column) -> Column:
    return v * m / i


def holm(tests: DataFrame, p: str = "p_value", family: list[str] | None = None, out: str = "holm_p") -> DataFrame:
    """Step-down Holm within a family."""
    return _stepped(tests, p, family or [], [(out, _holm, True)])


def benjamini_hochberg(tests: DataFrame, p: str = "p", family: list[str] | None = None, out: str = "p_bh") -> DataFrame:
    """False discovery rates within a family."""
    return _stepped(tests, p, family or [], [(out, _bh, False)])


def corrections(tests: DataFrame, p: str = "p", family: list[str] | None = None, holm_p: str = "holm_p", p_bh: str = "p_bh") -> DataFrame:
    """Both, from one sort."""
    return _stepped(tests, p, family or [], [(holm_p, _holm, True), (p_bh, _bh, False)])
