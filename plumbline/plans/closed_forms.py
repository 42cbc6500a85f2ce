"""Statistical models on designs whose estimates have closed forms, which the SQL states.

Customers in groups of five, with one value of x, z and m for each place in a group, make a balanced design: fixed effects are
those of least squares, and variances come from mean squares.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import models, moments, paired, variational
from .bindings import FLOATS, PAIRS, bound, event_types, read, trials

col = F.col


def groups(spark: SparkSession, d: str) -> DataFrame:
    """y in thousands; x, z = x**2 - 2 and m = x**3 add to 0 within a group; arm is constant in a group."""
    k, x = col("c_custkey"), (col("c_custkey") % 5 - 2).cast("double")
    g = F.floor(k / 5)
    return read(spark, d, "customer").select(g.alias("g"), x.alias("x"), (x * x - 2).alias("z"), (x * x * x).alias("m"), (g % 2).cast("double").alias("arm"), (col("c_acctbal") / 1000 + g % 7 * 5 + x * x * x / 8 + z_of(x)).alias("y"), (k % 7 + g % 2 > 3).cast("int").alias("hit"))


def z_of(x):
    return (x * x - 2) / 4


GROUPS = """d AS (SELECT g, x, x * x - 2 AS z, x * x * x AS m, g % 2 AS arm, c_acctbal / 1000 + g % 7 * 5 + x * x * x / 8 + (x * x - 2) / 4 AS y, (c_custkey % 7 + g % 2 > 3)::INT AS hit FROM (SELECT c_custkey, c_acctbal, c_custkey // 5 AS g, (c_custkey % 5 - 2)::DOUBLE AS x FROM customer)),
 gm AS (SELECT g, avg(y) AS my FROM d GROUP BY 1),
 s AS (SELECT count(*)::DOUBLE AS n, count(DISTINCT g)::DOUBLE AS k, avg(y) AS a, sum(x * y) / sum(x * x) AS bx, sum(z * y) / sum(z * z) AS bz, sum(x * x) AS sxx, sum(z * z) AS szz FROM d),
 ms AS (SELECT 5 * sum((my - a) ^ 2) / (any_value(k) - 1) AS msb FROM gm, s),
 r AS (SELECT *, (SELECT msb FROM ms) AS msb, (SELECT sum((y - my) ^ 2) FROM d JOIN gm USING (g)) AS ssw FROM s)"""


def _erfc(x: str) -> str:
    """The complementary error function of x >= 0 to seven places, by a fixed approximation."""
    t = f"(1 / (1 + 0.3275911::DOUBLE * ({x})))"
    return f"(((((1.061405429::DOUBLE * {t} - 1.453152027::DOUBLE) * {t} + 1.421413741::DOUBLE) * {t} - 0.284496736::DOUBLE) * {t} + 0.254829592::DOUBLE) * {t} * exp(-({x}) * ({x})))"


def _mixed(name: str, terms: dict[str, str]) -> str:
    """CTE ``name`` with the variances and R2 of the model with these slopes (term: its sum of squares)."""
    loss = "".join(f" - b{t} ^ 2 * {ss}" for t, ss in terms.items())
    fixed = " + ".join(f"b{t} ^ 2 * {ss} / n" for t, ss in terms.items())
    return f"{name} AS (SELECT *, fixed / (fixed + t2 + s2) AS r2 FROM (SELECT *, (msb - s2) / 5 AS t2 FROM (SELECT *, (ssw{loss}) / (n - k - {len(terms)}) AS s2, {fixed} AS fixed FROM r)))"


FLOATS["balanced_mixed_model"] = ["value"]


@bound("balanced_mixed_model", f"WITH {GROUPS}, {_mixed('f', {'x': 'sxx'})} SELECT unnest(['intercept', 'slope', 'se_intercept', 'se_slope', 'sigma2', 'tau2', 'icc', 'r2_marginal', 'r2_conditional', 'wald', 'contrast', 'contrast_se', 'contrast_low']) AS name, round(unnest([a, bx, sqrt(msb / n), sqrt(s2 / sxx), s2, t2, t2 / (t2 + s2), r2, (fixed + t2) / (fixed + t2 + s2), bx ^ 2 * sxx / s2, a + 2 * bx, sqrt(msb / n + 4 * s2 / sxx), a + 2 * bx - 1.96 * sqrt(msb / n + 4 * s2 / sxx)]), 3) AS value FROM f")
def q_mixed(spark, d):
    """M20 to M23, M25, M26."""
    fit = models.lmm(groups(spark, d), "y", ["intercept", "x"], "g")
    t, e, c = fit.table(), fit.extra, fit.contrast({"intercept": 1.0, "x": 2.0})
    values = {"intercept": t.estimate[0], "slope": t.estimate[1], "se_intercept": t.se[0], "se_slope": t.se[1], "sigma2": e["sigma2"], "tau2": e["tau2"], "icc": e["tau2"] / (e["tau2"] + e["sigma2"]), "r2_marginal": e["r2_marginal"], "r2_conditional": e["r2_conditional"], "wald": fit.wald(["x"])[0], "contrast": c["estimate"], "contrast_se": c["se"], "contrast_low": c["ci_low"]}
    return spark.createDataFrame([(n, round(float(v), 3)) for n, v in values.items()], "name string, value double")


@bound("balanced_importance", f"WITH {GROUPS}, {_mixed('fx', {'x': 'sxx'})}, {_mixed('fz', {'z': 'szz'})}, {_mixed('fxz', {'x': 'sxx', 'z': 'szz'})} SELECT 'x' AS block, round(fx.r2, 4) AS sequential, round(fxz.r2 - fz.r2, 4) AS drop_one FROM fx, fz, fxz UNION ALL SELECT 'z', round(fxz.r2 - fx.r2, 4), round(fxz.r2 - fx.r2, 4) FROM fx, fz, fxz")
def q_importance(spark, d):
    """M24, W9."""
    got = moments.importance(groups(spark, d), "y", {"x": ["x"], "z": ["z"]}, "g")
    return spark.createDataFrame([(r.block, round(float(r.sequential), 4), round(float(r.drop_one), 4)) for r in got.itertuples()], "block string, sequential double, drop_one double")


@bound("balanced_mediation", f"WITH {GROUPS}, q AS (SELECT sum(x * y) AS xy, sum(m * y) AS my, sum(x * x) AS xx, sum(x * m) AS xm, sum(m * m) AS mm FROM d), e AS (SELECT xy / xx AS total, (mm * xy - xm * my) / (xx * mm - xm * xm) AS direct, xm / xx AS a, (xx * my - xm * xy) / (xx * mm - xm * xm) AS b FROM q) SELECT round(total, 5) AS total, round(direct, 5) AS direct, round((total - direct) / total, 4) AS indirect_share, round(a, 5) AS a, round(b, 5) AS b FROM e")
def q_mediation(spark, d):
    """M27."""
    got = moments.mediation(groups(spark, d), "y", "x", ["m"], [], "g")
    every, m = got.iloc[0], got.iloc[1]
    return spark.createDataFrame([(round(float(every.total), 5), round(float(every.direct), 5), round(float(every.indirect_share), 4), round(float(m.a), 5), round(float(m.b), 5))], "total double, direct double, indirect_share double, a double, b double")


@bound("balanced_moderation", f"WITH {GROUPS}, q AS (SELECT arm, sum(x * y) / sum(x * x) AS b FROM d GROUP BY 1) SELECT round(max(b) FILTER (arm = 0), 5) AS slope, round(max(b) FILTER (arm = 1) - max(b) FILTER (arm = 0), 5) AS interaction FROM q")
def q_moderation(spark, d):
    """M28."""
    fit = models.moderation(groups(spark, d), "y", "x", "arm", [], "g")
    at = dict(zip(fit.names, fit.beta, strict=True))
    return spark.createDataFrame([(round(float(at["x"]), 5), round(float(at["x:arm"]), 5))], "slope double, interaction double")


_SLOPES = """c AS (SELECT g, sum(v) / sqrt(5.0::DOUBLE) AS c0, sum(x * v) / sqrt(10.0::DOUBLE) AS c1, sum(v * v) AS vv FROM (SELECT g, x, y + (g % 3 - 1) * x AS v FROM d) GROUP BY 1),
 k AS (SELECT count(*)::DOUBLE AS k, sum(vv - c0 * c0 - c1 * c1) AS rss, var_samp(c0) AS s00, var_samp(c1) AS s11, covar_samp(c0, c1) AS s01 FROM c),
 l AS (SELECT *, 3 * k * (ln(rss / (3 * k)) + 1) + (k - 1) * (ln(s00 * s11 - s01 * s01) + 2) AS full_d, (4 * k - 1) * (ln((rss + (k - 1) * s11) / (4 * k - 1)) + 1) + (k - 1) * (ln(s00) + 1) AS base_d FROM k)"""


@bound("balanced_random_slope", f"WITH {GROUPS}, {_SLOPES} SELECT round(base_d - full_d, 3) AS lr, round(exp((full_d - base_d) / 2), 4) AS p FROM l")
def q_random_slope(spark, d):
    """In a balanced design a cluster's mean and slope, scaled to the same error, have as REML covariance their sample covariance."""
    rows = groups(spark, d).withColumn("v", col("y") + (col("g") % 3 - 1) * col("x"))
    got = moments.random_slope(rows, "v", ["intercept", "x"], "x", "g")
    return spark.createDataFrame([(round(float(got["lr"]), 3), round(float(got["p"]), 4))], "lr double, p double")


@bound("vb_logistic")
def q_vb(spark, d):
    """M31."""
    fit = variational.vb_logistic(groups(spark, d).withColumn("x", col("x") / 2), "hit", ["intercept", "x", "arm"], "g")
    return spark.createDataFrame([(t, float(b), float(v) ** 0.5) for t, b, v in zip(fit.names, fit.beta, np.diag(fit.cov), strict=True)] + [("log deviation", fit.extra["log_deviation"], fit.extra["log_deviation_sd"])], "term string, mean double, sd double")


@bound("gee_saturated", f"WITH {GROUPS}, p AS (SELECT arm, avg(hit) AS p FROM d GROUP BY 1), l AS (SELECT arm, ln(p / (1 - p)) AS l FROM p) SELECT round(max(l) FILTER (arm = 0), 5) AS intercept, round(max(l) FILTER (arm = 1) - max(l) FILTER (arm = 0), 5) AS slope FROM l")
def q_gee_saturated(spark, d):
    """With one indicator that is constant in clusters of one size, log odds of the two kinds of cluster."""
    fit = models.gee_logit(groups(spark, d), "hit", ["intercept", "arm"], "g")
    return spark.createDataFrame([tuple(round(float(b), 5) for b in fit.beta)], "intercept double, slope double")


_RATES = "c AS (SELECT o_orderpriority AS condition, count(*) AS n, avg((o_orderstatus = 'F')::INT) AS p FROM orders GROUP BY 1), e AS (SELECT condition, ln(p / (1 - p)) AS lo, 1 / sqrt(n * p * (1 - p)) AS sd FROM c)"


def rates(spark: SparkSession, d: str):
    """One indicator a condition, without an intercept."""
    o = read(spark, d, "orders").select(col("o_orderpriority").alias("condition"), (col("o_orderstatus") == "F").cast("int").alias("y"))
    names = sorted(r[0] for r in o.select("condition").distinct().collect())
    wide, _ = models.dummies(o, "condition", ["", *names], "c")
    fit = models.logistic(wide, "y", [f"c[{n}]" for n in names])
    fit.names = names
    return models.condition_estimates(fit)


@bound("condition_estimates", f"WITH {_RATES} SELECT condition, round(lo, 4) AS log_odds, round(sd, 4) AS sd, round(1 / (1 + exp(-lo)), 4) AS probability, round(1 / (1 + exp(-(lo - 1.96 * sd))), 4) AS low, round(1 / (1 + exp(-(lo + 1.96 * sd))), 4) AS high FROM e")
def q_estimates(spark, d):
    """M32."""
    return spark.createDataFrame([(r.condition, *(round(float(getattr(r, c)), 4) for c in ("log_odds", "sd", "probability", "low", "high"))) for r in rates(spark, d).itertuples()], "condition string, log_odds double, sd double, probability double, low double, high double")


_ABOVE = _erfc("abs(diff / sd) / sqrt(2)")


@bound("registered_contrasts", f"WITH {_RATES}, x AS (SELECT a.condition || ' - ' || b.condition AS contrast, a.lo - b.lo AS diff, sqrt(a.sd ^ 2 + b.sd ^ 2) AS sd FROM e a JOIN e b ON a.condition = '1-URGENT' AND b.condition != '1-URGENT') SELECT contrast, round(diff, 4) AS log_odds, round(sd, 4) AS sd, round(exp(diff), 4) AS odds_ratio, round(exp(diff - 1.96 * sd), 4) AS low, round(exp(diff + 1.96 * sd), 4) AS high, round(CASE WHEN diff > 0 THEN 1 - {_ABOVE} / 2 ELSE {_ABOVE} / 2 END, 4) AS probability_above FROM x")
def q_contrasts(spark, d):
    """M33."""
    e = rates(spark, d)
    got = models.registered_contrasts(e, [("1-URGENT", c) for c in e.condition if c != "1-URGENT"])
    names = ["log_odds", "sd", "odds_ratio", "low", "high", "probability_above"]
    return spark.createDataFrame([(r.contrast, *(round(float(getattr(r, c)), 4) for c in names)) for r in got.itertuples()], "contrast string, " + ", ".join(f"{n} double" for n in names))


_P = _erfc("abs(effect) * sqrt(n) / sd / sqrt(2)")


@bound("holm_normal_tests", f"WITH {PAIRS}, tt AS (SELECT contrast, count(*) AS n, avg(diff) AS effect, stddev_samp(diff) AS sd FROM p GROUP BY 1), q AS (SELECT *, {_P} AS pv FROM tt), i AS (SELECT *, row_number() OVER (ORDER BY pv) AS i, count(*) OVER () AS k FROM q) SELECT contrast, n, round(effect, 4) AS effect, round(pv, 4) AS p, round(max(least(1.0::DOUBLE, pv * (k - i + 1))) OVER (ORDER BY i), 4) AS holm_p FROM i")
def q_holm_tests(spark, d):
    """M35, T4."""
    got = models.holm_normal_tests(paired.paired_differences(trials(spark, d), event_types(spark, d)))
    return spark.createDataFrame([(r.contrast, int(r.n), round(float(r.effect), 4), round(float(r.p), 4), round(float(r.holm_p), 4)) for r in got.itertuples()], "contrast string, n bigint, effect double, p double, holm_p double")


@bound("ols_cluster_robust", """WITH l AS (SELECT l_suppkey AS g, l_quantity AS y, date_diff('day', o_orderdate::DATE, l_shipdate::DATE)::DOUBLE AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 s AS (SELECT count(*)::DOUBLE AS n, sum(x) AS sx, sum(x * x) AS sxx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM l), c AS (SELECT g, sum(y - a - b * x) AS u, sum(x * (y - a - b * x)) AS v FROM l, s GROUP BY 1),
 w AS (SELECT sum(u * u) AS uu, sum(u * v) AS uv, sum(v * v) AS vv, count(*)::DOUBLE AS k FROM c), i AS (SELECT *, sxx / (n * sxx - sx * sx) AS i00, -sx / (n * sxx - sx * sx) AS i01, n / (n * sxx - sx * sx) AS i11 FROM s, w)
 SELECT round(a, 4) AS intercept, round(b, 6) AS slope, round(sqrt(k / (k - 1) * (n - 1) / (n - 2) * (i00 * i00 * uu + 2 * i00 * i01 * uv + i01 * i01 * vv)), 5) AS se_intercept, round(sqrt(k / (k - 1) * (n - 1) / (n - 2) * (i01 * i01 * uu + 2 * i01 * i11 * uv + i11 * i11 * vv)), 6) AS se_slope FROM i""")
def q_ols_robust(spark, d):
    """With covariance robust to clusters."""
    li, o = read(spark, d, "lineitem"), read(spark, d, "orders")
    rows = li.join(o, li.l_orderkey == o.o_orderkey).select("l_suppkey", F.datediff(col("l_shipdate").cast("date"), col("o_orderdate").cast("date")).cast("double").alias("x"), col("l_quantity").alias("y"))
    fit = models.ols(rows, "y", ["intercept", "x"], "l_suppkey")
    se = np.sqrt(np.diag(fit.cov))
    return spark.createDataFrame([(round(float(fit.beta[0]), 4), round(float(fit.beta[1]), 6), round(float(se[0]), 5), round(float(se[1]), 6))], "intercept double, slope double, se_intercept double, se_slope double")
