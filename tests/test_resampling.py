"""Bootstraps by bucket against draws made in one place."""

import math

import numpy as np
import pytest

from plumbline.operators import resampling as R


@pytest.mark.parametrize("kind", [R.Md5, R.Pcg])
@pytest.mark.parametrize("sizes", [[7], [5, 0, 9], [0, 0, 4, 1, 30], [3] * 16])
def test_buckets_share_all_draws(kind, sizes):
    rounds = 40
    draws = [R.bucket_draws(kind(3, "c"), np.array(sizes), b, rounds) for b in range(len(sizes))]
    assert (sum(draws) == sum(sizes)).all() and all((d >= 0).all() for d in draws)
    assert all((d == 0).all() for d, s in zip(draws, sizes, strict=True) if not s)


@pytest.mark.parametrize("kind", [R.Md5, R.Pcg])
def test_draws_are_multinomial(kind):
    sizes, rounds = np.array([10, 30, 60]), 600
    draws = np.array([R.bucket_draws(kind(1, "x"), sizes, b, rounds) for b in range(3)])
    assert draws.mean(1) == pytest.approx(sizes, abs=1.2)
    assert draws.var(1) == pytest.approx(100 * (sizes / 100) * (1 - sizes / 100), rel=0.2)


def test_quantile_is_the_binomials():
    masses = [0.4**5, 5 * 0.6 * 0.4**4, 10 * 0.36 * 0.4**3, 10 * 0.216 * 0.16, 5 * 0.6**4 * 0.4, 0.6**5]
    for u in np.linspace(0.001, 0.999, 50):
        assert R.quantile(5, 0.6, u) == int((np.cumsum(masses)[:-1] < u).sum())
    assert [R.quantile(4, 0.0, 0.5), R.quantile(4, 1.0, 0.5), R.quantile(0, 0.3, 0.5)] == [0, 4, 0]


@pytest.mark.parametrize("draws, rounds, buckets", [("pcg64", 5000, 8), ("pcg64", 500, 1), ("md5", 60, 8)])
def test_means(spark, draws, rounds, buckets):
    """Each round's mean is that of the buckets' draws; intervals are near the normal ones; partitions do not matter."""
    rng = np.random.default_rng(5)
    values = {"a": rng.normal(1, 2, 400), "b": rng.normal(0, 1, 37), "c": np.array([4.0])}
    rows = [(c, f"t{n}", float(v)) for c, vs in values.items() for n, v in enumerate(vs)]
    df = spark.createDataFrame([*rows, ("a", "none", None), ("d", "t", None)], "contrast string, task_key string, diff double")
    got = {}
    for r in R.resampled_means(df.repartition(5), rounds, 9, buckets=buckets, draws=draws).collect():
        got.setdefault(r.contrast, np.zeros(rounds))[r.round] = r.mean
    again = {(r.contrast, r.round): r.mean for r in R.resampled_means(df.repartition(2), rounds, 9, buckets=buckets, draws=draws).collect()}
    assert set(got) == {"a", "b", "c"} and all(got[c][r] == pytest.approx(m) for (c, r), m in again.items())
    kind = {"md5": R.Md5, "pcg64": R.Pcg}[draws]
    for c, means in got.items():
        mine = sorted(x[1:] for x in rows if x[0] == c)
        at = [R._digits(t) % buckets for t, _ in mine]
        sizes, source = np.array([at.count(b) for b in range(buckets)]), kind(9, c)
        want = sum(source.sums(b, R.bucket_draws(source, sizes, b, rounds), np.array([v for (_, v), k in zip(mine, at, strict=True) if k == b])) for b in range(buckets) if sizes[b]) / len(mine)
        assert means == pytest.approx(want)
    if rounds == 5000:
        low, high = np.quantile(got["a"], [0.025, 0.975])
        error = values["a"].std() / 20
        assert [low, high] == pytest.approx([values["a"].mean() - 1.96 * error, values["a"].mean() + 1.96 * error], abs=0.04)
    assert (got["c"] == 4.0).all()


def test_figure_tables(spark):
    rows = [(t, arm, None if t == 3 else f"bin{t % 2}", float(t % 3), None if t == 1 else 1.0) for t in range(12) for arm in "xy" for _ in range(2)]
    df = spark.createDataFrame(rows, "task_key int, arm string, bin string, gated double, judge double")
    got = {(r.table, r.cell, r.outcome): r for r in R.figure_tables(df, {"one": ["arm", "bin"], "two": ["arm"]}, ["gated", "judge"], rounds=50).collect()}
    assert len(got) == 2 * 4 + 2 * 2
    r = got["one", "x|bin1", "gated"]
    tasks = [t for t in range(12) if t % 2 and t != 3]
    assert (r.n_tasks, r.n_rows) == (5, 10) and r.mean == pytest.approx(np.mean([t % 3 for t in tasks])) and r.ci_low <= r.mean <= r.ci_high
    assert got["two", "y", "judge"].n_tasks == 11 and got["two", "y", "judge"].ci_high == 1.0


def test_quantile_of_many_draws():
    """The masses around the mean alone give what all of them give."""
    def whole(draws, p, u):
        k = np.arange(draws)
        logs = np.array([math.lgamma(draws + 1) - math.lgamma(x + 1) - math.lgamma(draws - x + 1) for x in k.tolist()])
        return int((np.cumsum(np.exp(logs + k * math.log(p) + (draws - k) * math.log1p(-p))) < u).sum())

    for draws, p in ((1, 0.5), (7, 0.3), (900, 0.001), (5000, 0.5), (20000, 0.249)):
        assert all(R.quantile(draws, p, u) == whole(draws, p, u) for u in (2**-33, 0.01, 0.5, 0.9999, 1 - 2**-33))


def test_buckets_are_streamed(spark):
    """No list of a bucket's tasks is made, and the order of tasks alone decides, in however many batches a bucket comes."""
    rows = [(f"c{n % 3}", n, float(n % 17)) for n in range(6000)]
    df = spark.createDataFrame(rows, "contrast string, task_key int, diff double").repartition(7)
    out = R.resampled_means(df, 5, buckets=4, draws="md5")
    assert "collect_list(struct(task" not in out._jdf.queryExecution().optimizedPlan().toString()
    whole = {(r.contrast, r.round): r.mean for r in out.collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        parts = {(r.contrast, r.round): r.mean for r in R.resampled_means(df, 5, buckets=4, draws="md5").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(whole) == 15 and parts == pytest.approx(whole)
    # by hand, for one contrast
    mine = [(str(t), d) for c, t, d in rows if c == "c1"]
    dealt = [sorted(x for x in mine if R._digits(x[0]) % 4 == b) for b in range(4)]
    sizes, source = np.array([len(x) for x in dealt]), R.Md5(7, "c1")
    draws = [R.bucket_draws(source, sizes, b, 5) for b in range(4)]
    for r in range(5):
        drawn = [dealt[b][R._digits(f"7:c1:{b}:{r}:{j}") % sizes[b]][1] for b in range(4) for j in range(draws[b][r])]
        assert whole["c1", r] == pytest.approx(sum(drawn) / len(mine))
