"""Corrections for multiplicity against sorting in one place."""

import math
import random

import pytest

from pyspark.sql import functions as F

from plumbline.operators.multiplicity import benjamini_hochberg, corrections, holm


def brute(ps):
    """Holm and BH of a family, by place."""
    order = sorted((n for n, p in enumerate(ps) if p is not None and not math.isnan(p)), key=lambda n: ps[n])
    m, worst, step_down, rates = len(order), 0.0, {}, {}
    for i, n in enumerate(order):
        worst = max(worst, min(1.0, (m - i) * ps[n]))
        step_down[n] = worst
    least = 1.0
    for i, n in reversed(list(enumerate(order, 1))):
        least = min(least, ps[n] * m / i)
        rates[n] = least
    return step_down, rates


@pytest.mark.parametrize("partitions", [1, 5])
def test_families(spark, partitions):
    rng = random.Random(1)
    families = {"all": [rng.random() ** 4 for _ in range(400)], "ties": [rng.choice([0.001, 0.01, 0.2]) for _ in range(60)], None: [0.5, None, float("nan"), 0.01], "one": [0.03], "none": [None]}
    rows = [(f, n, p) for f, ps in families.items() for n, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "f string, n int, p double").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        both = benjamini_hochberg(holm(df, "p", ["f"]), "p", ["f"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(both) == len(rows)
    for f, ps in families.items():
        step_down, rates = brute(ps)
        got = {r.n: (r.holm_p, r.p_bh) for r in both if r.f == f}
        assert got == {n: (pytest.approx(step_down[n]), pytest.approx(rates[n])) if n in rates else (None, None) for n in range(len(ps))}


def test_one_family(spark):
    ps = [0.04, 0.01, 0.03]
    got = {r.n: r.holm_p for r in holm(spark.createDataFrame(list(enumerate(ps)), "n int, p_value double")).collect()}
    assert got == pytest.approx(brute(ps)[0])
    assert holm(spark.createDataFrame([], "n int, p_value double")).collect() == []


def test_large_block(spark):
    """A block's least values are found in one go, also where one block has very many tests; both corrections from one sort."""
    n = 60_000
    rows = spark.range(n).select((F.col("id") * 7919 % 59_999).alias("k")).select("k", ((F.col("k") + 1) / 60_001.0).alias("p"))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        both = corrections(rows)
        frames = both._jdf.queryExecution().optimizedPlan().toString()
        got = both.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert "RowFrame" in frames and "currentrow$(), unboundedfollowing$()" not in frames  # such frames are quadratic in a block
    order = sorted(range(n), key=lambda i: got[i].p)
    step_down, rates = brute([r.p for r in got])
    assert len(got) == n and all(got[i].holm_p == pytest.approx(step_down[i]) and got[i].p_bh == pytest.approx(rates[i]) for i in order)
