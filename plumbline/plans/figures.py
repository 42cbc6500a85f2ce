"""Bootstrap intervals and figure tables on the driver's tables.

The SQL repeats the draws: a bucket's share of a round's draws from binomial quantiles down a tree over four buckets, then the
tasks, all by md5 digits.  It has fewer rounds than the 5000 of the operators, whose other generator SQL lacks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import paired, resampling
from . import reports
from .bindings import FLOATS, PAIRS, bound, event_types, read, trials

col = F.col
HOW = {"buckets": 4, "draws": "md5"}


def _digits(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


def _split(name: str, of: str, draws: str, part: str, whole: str, node: int) -> str:
    """CTEs that add ``name``, the share of ``draws`` that falls to ``part`` of ``whole`` tasks, to the rows of ``of``."""
    mass = "exp(lgamma(d + 1) - lgamma(k + 1) - lgamma(d - k + 1) + k * ln(p) + (d - k) * ln(1 - p))"
    return f"""{name}_p AS (SELECT contrast, round, {draws} AS d, {part} / greatest({whole}, 1)::DOUBLE AS p, ({_digits(f"'7:' || contrast || ':n{node}:' || round")} + 0.5) / 4294967296 AS u FROM {of}),
 {name}_c AS (SELECT contrast, round, u, sum(m) OVER (PARTITION BY contrast, round ORDER BY k ROWS UNBOUNDED PRECEDING) AS c FROM (SELECT *, {mass} AS m FROM (SELECT *, unnest(range(d)) AS k FROM {name}_p WHERE p > 0 AND p < 1))),
 {name}_q AS (SELECT contrast, round, count(*) FILTER (c < u) AS q FROM {name}_c GROUP BY ALL),
 {name}_t AS (SELECT o.*, CASE WHEN p >= 1 THEN d ELSE coalesce(q, 0) END AS {name} FROM {of} o JOIN {name}_p USING (contrast, round) LEFT JOIN {name}_q USING (contrast, round))"""


def resampled(values: str, rounds: int) -> str:
    """CTEs up to m (contrast, round, mean), from a relation ``values`` (contrast, task_key, diff)."""
    return f"""bk AS (SELECT contrast, task_key::VARCHAR AS task, diff, {_digits("task_key::VARCHAR")} % 4 AS bucket FROM {values} WHERE diff IS NOT NULL),
 nr AS (SELECT *, row_number() OVER (PARTITION BY contrast, bucket ORDER BY task) - 1 AS i FROM bk),
 sz AS (SELECT contrast, count(*) AS n, {", ".join(f"count(*) FILTER (bucket = {b}) AS n{b}" for b in range(4))} FROM bk GROUP BY 1),
 rd AS (SELECT *, unnest(range({rounds})) AS round FROM sz),
 {_split("h", "rd", "n", "(n0 + n1)", "n", 1)},
 {_split("m0", "h_t", "h", "n0", "(n0 + n1)", 2)},
 {_split("m2", "m0_t", "(n - h)", "n2", "(n2 + n3)", 3)},
 dr AS (SELECT contrast, round, n, unnest([0, 1, 2, 3]) AS bucket, unnest([m0, h - m0, m2, n - h - m2]) AS m, unnest([n0, n1, n2, n3]) AS size FROM m2_t),
 pk AS (SELECT contrast, round, n, bucket, {_digits("'7:' || contrast || ':' || bucket || ':' || round || ':' || j")} % size AS i FROM (SELECT *, unnest(range(m)) AS j FROM dr)),
 m AS (SELECT contrast, round, sum(diff) / any_value(n) AS mean FROM pk JOIN nr USING (contrast, bucket, i) GROUP BY 1, 2)"""


FLOATS["bootstrap_interval"] = FLOATS["bootstrap_floor_interval"] = ["ci_low", "ci_high"]
FLOATS["figure_tables"] = ["mean", "ci_low", "ci_high"]
FLOATS["figure_gains"] = ["effect", "ci_low", "ci_high"]


def differences(spark: SparkSession, d: str) -> DataFrame:
    return paired.paired_differences(trials(spark, d), event_types(spark, d))


@bound("bootstrap_interval", f"WITH {PAIRS}, {resampled('p', 200)} SELECT contrast, quantile_cont(mean, 0.025) AS ci_low, quantile_cont(mean, 0.975) AS ci_high FROM m GROUP BY 1")
def q_bootstrap(spark, d):
    """M2 to M4."""
    return paired.bootstrap_bounds(resampling.resampled_means(differences(spark, d), 200, **HOW), "linear")


@bound("bootstrap_floor_interval", f"WITH {PAIRS}, {resampled('p', 200)}, s AS (SELECT contrast, list_sort(list(mean)) AS m FROM m GROUP BY 1) SELECT contrast, m[floor(0.025 * (len(m) - 1))::INT + 1] AS ci_low, m[floor(0.975 * (len(m) - 1))::INT + 1] AS ci_high FROM s")
def q_bootstrap_floor(spark, d):
    """M1."""
    return paired.bootstrap_bounds(resampling.resampled_means(differences(spark, d), 200, **HOW))


@bound("bootstrap_5000")
def q_bootstrap_full(spark, d):
    """M1 to M4 with all rounds."""
    return resampling.intervals(differences(spark, d))


def variable_rows(spark: SparkSession, d: str) -> DataFrame:
    """``events`` as results of models (by user region of the day) under arms, with an age and a latency."""
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, d, "events").select(
        col("user_id").alias("task_key"), col("event_type").alias("arm"), F.concat(F.lit("m"), k % 3).alias("model"), F.when(k % 11 > 0, F.concat(F.lit("age"), k % 4)).alias("age_bin"),
        F.concat(F.lit("q"), F.when(col("value") < 20, 1).when(col("value") < 60, 2).otherwise(3)).alias("quartile"), F.when(k % 5 == 0, "numbers").otherwise("other").alias("question_type"),
        F.when(k % 2 == 0, (k % 4 == 0).cast("int")).alias("visible"), (col("value") > 50).cast("int").alias("gated"), F.when(k % 7 > 0, (col("value") > 30).cast("int")).alias("judge"),
    )


_VARIABLE = """e AS (SELECT *, json_extract(props, '$.k')::INT AS k FROM events),
 vr AS (SELECT user_id AS task_key, event_type AS arm, 'm' || (k % 3) AS model, CASE WHEN k % 11 > 0 THEN 'age' || (k % 4) END AS age_bin, 'q' || CASE WHEN value < 20 THEN 1 WHEN value < 60 THEN 2 ELSE 3 END AS quartile,
        CASE WHEN k % 5 = 0 THEN 'numbers' ELSE 'other' END AS question_type, CASE WHEN k % 2 = 0 THEN (k % 4 = 0)::INT END AS visible, (value > 50)::INT AS gated, CASE WHEN k % 7 > 0 THEN (value > 30)::INT END AS judge FROM e)"""
_CELLS = " UNION ALL ".join(f"SELECT '{name}' AS tbl, {' || chr(124) || '.join(f'{k}::VARCHAR' for k in keys)} AS cell, '{o}' AS outcome, task_key, {o} AS v FROM vr" for name, keys in reports.FIGURES.items() for o in ("gated", "judge"))


@bound("figure_tables", f"""WITH {_VARIABLE}, ce AS (SELECT tbl, cell, outcome, task_key, avg(v) AS diff, count(*) AS n, tbl || ':' || cell || ':' || outcome AS contrast FROM ({_CELLS}) WHERE cell IS NOT NULL AND v IS NOT NULL GROUP BY ALL),
 {resampled("ce", 40)}, b AS (SELECT contrast, quantile_cont(mean, 0.025) AS ci_low, quantile_cont(mean, 0.975) AS ci_high FROM m GROUP BY 1)
 SELECT tbl AS "table", cell, outcome, count(*) AS n_tasks, sum(n)::BIGINT AS n_rows, avg(diff) AS mean, any_value(ci_low) AS ci_low, any_value(ci_high) AS ci_high FROM ce JOIN b USING (contrast) GROUP BY 1, 2, 3""")
def q_figures(spark, d):
    """Six tables with intervals from one pass."""
    return reports.variable_tables(variable_rows(spark, d), ["gated", "judge"], 40, **HOW)


@bound("figure_gains", f"""WITH {_VARIABLE}, w AS (SELECT model || '|' || age_bin AS contrast, task_key, avg(gated) FILTER (arm = 'purchase') - avg(gated) FILTER (arm = 'view') AS diff FROM vr WHERE age_bin IS NOT NULL GROUP BY 1, 2),
 {resampled("w", 100)}, b AS (SELECT contrast, quantile_cont(mean, 0.025) AS ci_low, quantile_cont(mean, 0.975) AS ci_high FROM m GROUP BY 1)
 SELECT contrast, count(*) AS n_tasks, avg(diff) AS effect, any_value(ci_low) AS ci_low, any_value(ci_high) AS ci_high FROM w JOIN b USING (contrast) WHERE diff IS NOT NULL GROUP BY 1""")
def q_gains(spark, d):
    """M13."""
    return reports.age_gains(variable_rows(spark, d), "purchase", "view", "gated", 100, **HOW)
