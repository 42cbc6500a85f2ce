"""Registered queries and the operators behind them, against brute force on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import containment, paired
from plumbline.plans import tables
from plumbline.plans.registry import QUERIES, SQL

#: No SQL has gzip, Unicode folding, or the optimiser and generator of these models.
WITHOUT_SQL = {"cluster_bootstrap", "score_compression_redundancy", "answer_normalization", "mixed_model", "logistic_cluster_robust", "gee_logit", "vb_logistic", "bootstrap_5000"}


def test_queries_have_sql():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL and set(SQL) <= set(QUERIES) and len(QUERIES) > 140


def brute_rank(values, p):
    values = sorted(values)
    return values[round((len(values) - 1) * p)]


@pytest.mark.parametrize("p", [0.0, 0.5, 0.95, 1.0])
def test_nearest_rank_by(spark, p):
    rng = random.Random(5)
    groups = {"many": [rng.random() for _ in range(20000)], "ties": [float(rng.randint(0, 3)) for _ in range(5000)], "few": [3.0, 1.0, 2.0], "one": [7.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("few", None), ("none", None)], "g string, v double").repartition(5)
    assert {r.g: r.p_value for r in paired.nearest_rank_by(df, "g", "v", p).collect()} == {g: brute_rank(vs, p) for g, vs in groups.items()}


@pytest.mark.parametrize("limit", [16 << 20, 60, 8])
def test_containing(spark, monkeypatch, limit):
    """All golds in one scan; joined by inner words but for short ones; those in several scans."""
    monkeypatch.setattr(containment, "GOLD_BYTES", limit)
    golds = ["the quick brown fox jumps", "one two three four", "alpha beta gamma", "xy", "two words", "Ünder  the\nsea, far", "a", "words two", "Alpha beta gamma", "fox", "the quick brown fox jumps over everything"]
    texts = ["zzthe quick brown fox jumpsly", "the quick  brown fox jumps", "ONE TWO THREE FOUR five", "prealpha beta gammas", "wxyz", "two  words", "two words two words", "ünder  the\nsea, far away", "he said: the quick brown fox jumps over everything", "", None, "the quick brown fox"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    g = spark.createDataFrame([*enumerate(golds), (50, ""), (51, None)], "item_id int, text string")
    want = {(n, k) for n, t in enumerate(texts) for k, x in enumerate(golds) if t is not None and x.lower() in t.lower()}
    got = [(r.doc_id, r.item_id) for r in containment.containing(d, g, "doc_id", "item_id").collect()]
    assert set(got) == want and len(got) == len(want) and len(want) >= 8
    assert containment.containing(d, g.limit(0), "doc_id", "item_id").collect() == []


def test_metric_effects(spark):
    rows = [(1, "a", 5.0, 1.0), (1, "b", 3.0, None), (2, "a", 1.0, 2.0), (2, "b", 2.0, 1.0), (3, "a", 9.0, 9.0)]
    out = paired.metric_effects(spark.createDataFrame(rows, "task_key int, condition string, x double, y double"), ["x", "y"], [("a", "b")])
    assert {(r.metric, r.n, r.effect) for r in out.collect()} == {("x", 2, 0.5), ("y", 1, 1.0)}


def test_waits(spark):
    df = spark.createDataFrame([("Wed, 01 Jan 2025 00:00:30 GMT",), ("7.5",), ("x",)], "w string")
    got = [r.s for r in df.select(T.retry_seconds(F.col("w"), F.lit("2025-01-01 00:00:00").cast("timestamp")).alias("s")).collect()]
    assert got == [30.0, 7.5, None]


def test_span_scan_takes_the_filter(spark):
    plan = tables.q_spans(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(origin.object_type,dataset)" in plan and "metrics" not in plan.split("ReadSchema")[1]
