"""Trial aggregation, paired effects, bootstraps, frontiers, windows and corrections for multiplicity.

Operators take DataFrames and column names.  Contrasts of one table are computed from one pivoted pass (a
shuffle on the task key), not from a self-join for each contrast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# --- percentiles --------------------------------------------------------------------------------------------
def nearest_rank(values: Column, p: float) -> Column:
    """Element round((n-1)p) of an array, with banker's rounding (A3)."""
    return F.element_at(F.array_sort(values), (F.bround((F.size(values) - 1) * F.lit(p).cast("double")) + 1).cast("int"))


def nearest_rank_by(rows: DataFrame, by: str, value: str, p: float, slack: float = 0.001) -> DataFrame:
    """(by, p_value): element round((n-1)p) of each group's values, with banker's rounding (A3).

    Approximate quantiles to either side bracket it; rows below the bracket are counted, and those within, some
    ``2 * slack`` of a group, numbered.  So no group is gathered in a row or sorted whole.
    """
    rows = rows.select(by, F.col(value).alias("__v")).where("__v is not null")
    sides = F.array(F.lit(max(0.0, p - slack)), F.lit(min(1.0, p + slack)))
    bounds = rows.groupBy(by).agg(F.count("*").alias("__n"), F.percentile_approx("__v", sides, int(4 / slack)).alias("__b"))
    bounds = bounds.select(by, "__n", F.when(F.col("__n") > 1000, F.col("__b")[0]).alias("__lo"), F.when(F.col("__n") > 1000, F.col("__b")[1]).alias("__hi"))
    placed = rows.join(bounds, by)
    below = placed.groupBy(by).agg(F.count_if(F.col("__v") < F.col("__lo")).alias("__below"))
    within = placed.where("__lo is null or __v between __lo and __hi").join(below, by)
    at = F.col("__below") + F.row_number().over(Window.partitionBy(by).orderBy("__v"))
    return within.withColumn("__at", at).where(F.col("__at") == F.bround((F.col("__n") - 1) * F.lit(p).cast("double")) + 1).select(by, F.col("__v").alias("p_value"))


def linear_percentile(column: str, p: float) -> Column:
    """Linear interpolation between ranks."""
    return F.percentile(column, p)


# --- trials -------------------------------------------------------------------------------------------------
def aggregate_trials(rows: DataFrame, measures: list[str], task: str = "task_key", condition: str = "condition", category: str | None = "category", order: str = "line_no") -> DataFrame:
    """Means over trials, nulls left out, the category of the first trial, and the number of trials (A1, A2)."""
    first = [F.min_by(category, order).alias(category)] if category else []
    return rows.groupBy(task, condition).agg(*[F.avg(m).alias(m) for m in measures], *first, F.count("*").alias("trials"))


def condition_summary(rows: DataFrame, keys: list[str], measures: list[str], task: str = "task_key", p95: str | None = None) -> DataFrame:
    """Rows, distinct tasks, means, and one linear 95th percentile."""
    more = [linear_percentile(p95, 0.95).alias(f"{p95}_p95")] if p95 else []
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.countDistinct(task).alias("tasks"), *[F.avg(m).alias(f"{m}_mean") for m in measures], *more)


def task_means(rows: DataFrame, metric: str, task: str = "task_key", condition: str = "condition") -> DataFrame:
    """A8."""
    return rows.groupBy(task, condition).agg(F.avg(metric).alias(metric))


# --- paired effects -----------------------------------------------------------------------------------------
def paired_differences(trials: DataFrame, contrasts: list[tuple[str, str]], score: str = "score", task: str = "task_key", condition: str = "condition", category: str = "category") -> DataFrame:
    """(contrast, task, category, diff) for each contrast (a, b) = a - b on tasks that have both."""
    names = sorted({c for pair in contrasts for c in pair})
    wide = trials.where(F.col(condition).isin(*names)).groupBy(task).agg(
        *[F.max(F.when(F.col(condition) == c, F.col(score))).alias(f"v{n}") for n, c in enumerate(names)],
        *[F.max(F.when(F.col(condition) == c, F.col(category))).alias(f"c{n}") for n, c in enumerate(names)],
    )
    at = {c: n for n, c in enumerate(names)}
    each = F.array(*[F.struct(F.lit(f"{a} - {b}").alias("contrast"), F.coalesce(f"c{at[b]}", f"c{at[a]}").alias("category"), (F.col(f"v{at[a]}") - F.col(f"v{at[b]}")).alias("diff")) for a, b in contrasts])
    return wide.select(task, F.explode(each).alias("e")).select(F.col("e.contrast").alias("contrast"), F.col(task), F.col("e.category").alias("category"), F.col("e.diff").alias("diff")).where("diff is not null")


def metric_effects(trials: DataFrame, metrics: list[str], contrasts: list[tuple[str, str]], task: str = "task_key", condition: str = "condition") -> DataFrame:
    """(metric, contrast, n, effect) of all contrasts of all metrics (M6, M7): one pivot by task and metric."""
    long = trials.unpivot([task, condition], metrics, "metric", "value")
    names = sorted({c for pair in contrasts for c in pair})
    wide = long.where(F.col(condition).isin(*names)).groupBy(task, "metric").agg(*[F.max(F.when(F.col(condition) == c, F.col("value"))).alias(f"v{n}") for n, c in enumerate(names)])
    at = {c: n for n, c in enumerate(names)}
    each = F.array(*[F.struct(F.lit(f"{a} - {b}").alias("contrast"), (F.col(f"v{at[a]}") - F.col(f"v{at[b]}")).alias("diff")) for a, b in contrasts])
    return wide.select("metric", F.explode(each).alias("e")).where("e.diff is not null").groupBy("metric", "e.contrast").agg(F.count("*").alias("n"), F.avg("e.diff").alias("effect"))


def paired_effects(differences: DataFrame) -> DataFrame:
    """Effect, wins, ties, losses and the mean of category means, by contrast (A4, A5)."""
    balanced = differences.groupBy("contrast", "category").agg(F.avg("diff").alias("m")).groupBy("contrast").agg(F.avg("m").alias("category_balanced"))
    plain = differences.groupBy("contrast").agg(F.count("*").alias("n"), F.avg("diff").alias("effect"), F.count_if(F.col("diff") > 0).alias("wins"), F.count_if(F.col("diff") == 0).alias("ties"), F.count_if(F.col("diff") < 0).alias("losses"))
    return plain.join(balanced, "contrast")


def reversed_effects(effects: DataFrame) -> DataFrame:
    """The contrasts the other way round: signs, bounds, wins and losses change places."""
    turn = {"effect": -F.col("effect"), "wins": F.col("losses"), "losses": F.col("wins")}
    if "ci_low" in effects.columns:
        turn |= {"ci_low": -F.col("ci_high"), "ci_high": -F.col("ci_low")}
    return effects.select(*[turn[c].alias(c) if c in turn else F.col(c) for c in effects.columns])


def category_effects(differences: DataFrame, least: int = 10) -> DataFrame:
    """A9, U4."""
    return differences.groupBy("contrast", "category").agg(F.count("*").alias("n"), F.avg("diff").alias("effect")).where(F.col("n") >= least)


def difference_in_differences(gains: DataFrame, model: str = "model", task: str = "task_key", gain: str = "gain") -> DataFrame:
    """Mean difference of two models' gains on the tasks that both have, for every pair of models."""
    a = gains.select(task, F.col(model).alias("model_a"), F.col(gain).alias("g_a"))
    b = gains.select(task, F.col(model).alias("model_b"), F.col(gain).alias("g_b"))
    pairs = a.join(b, task).where("model_a < model_b and g_a is not null and g_b is not null")
    return pairs.groupBy("model_a", "model_b").agg(F.count("*").alias("n"), F.avg(F.col("g_a") - F.col("g_b")).alias("effect"))


def mediator_deltas(rows: DataFrame, mediators: list[str], keys: list[str], task: str, condition: str, a: str, b: str) -> DataFrame:
    """Mean paired change of each mediator (A10)."""
    long = rows.unpivot([*keys, task, condition], mediators, "mediator", "value").where("value is not null")
    wide = long.groupBy(*keys, task, "mediator").agg(F.avg(F.when(F.col(condition) == a, F.col("value"))).alias("a"), F.avg(F.when(F.col(condition) == b, F.col("value"))).alias("b"))
    return wide.where("a is not null and b is not null").groupBy(*keys, "mediator").agg(F.count("*").alias("n"), F.avg(F.col("a") - F.col("b")).alias("delta"))


# --- bootstraps ---------------------------------------------------------------------------------------------
def bootstrap_bounds(means: DataFrame, method: str = "floor") -> DataFrame:
    """95 % bounds by contrast: ``floor`` takes elements floor(.025(B-1)) and floor(.975(B-1)), ``linear`` interpolates."""
    if method == "linear":
        return means.groupBy("contrast").agg(F.percentile("mean", 0.025).alias("ci_low"), F.percentile("mean", 0.975).alias("ci_high"))
    ranked = means.groupBy("contrast").agg(F.array_sort(F.collect_list("mean")).alias("m"))
    at = lambda p: F.element_at("m", (F.floor((F.size("m") - 1) * F.lit(p)) + 1).cast("int"))
    return ranked.select("contrast", at(0.025).alias("ci_low"), at(0.975).alias("ci_high"))


def cluster_bootstrap(rows: DataFrame, keys: list[str], value: str, cluster: str, rounds: int = 5000, seed: int = 20260826, seed_text: Column | None = None) -> DataFrame:
    """Mean over cluster means with a linear 95 % interval, resampling clusters with numpy's PCG64 (M2, M3, M4).

    One group's cluster means go to one task: tasks of a study, not raw rows, which are averaged before.
    """
    means = rows.where(F.col(value).isNotNull()).groupBy(*keys, cluster).agg(F.avg(value).alias("v"), F.count("*").alias("c"))
    means = means.withColumn("s", (seed_text if seed_text is not None else F.lit(0)).cast("bigint"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        values = frame.sort_values(cluster)["v"].to_numpy()
        rng = np.random.default_rng(seed + int(frame["s"].iloc[0]))
        parts, left = [], rounds
        while left:
            n = min(250, left)
            parts.append(values[rng.integers(0, len(values), (n, len(values)))].mean(1))
            left -= n
        low, high = np.quantile(np.concatenate(parts), [0.025, 0.975])
        return pd.DataFrame([[*(frame[k].iloc[0] for k in keys), len(values), int(frame["c"].sum()), values.mean(), low, high]], columns=[*keys, "n_tasks", "n_rows", "mean", "ci_low", "ci_high"])

    kinds = {f.name: f.dataType.simpleString() for f in means.schema}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", n_tasks bigint, n_rows bigint, mean double, ci_low double, ci_high double"
    return means.groupBy(*keys).applyInPandas(run, schema)


# --- frontiers, windows, corrections ------------------------------------------------------------------------
def pareto(summary: DataFrame, cost: str, score: str, key: str) -> DataFrame:
    """Rows that no other row beats: at most the cost and at least the score, one of them strictly (M5).

    ``summary`` has a row a condition, so the comparison of all pairs is of a handful of rows.
    """
    known = summary.where(F.col(cost).isNotNull() & F.col(score).isNotNull())
    o = known.select(F.col(key).alias("__k"), F.col(cost).alias("__c"), F.col(score).alias("__s"))
    beats = (F.col("__c") <= F.col(cost)) & (F.col("__s") >= F.col(score)) & ((F.col("__c") < F.col(cost)) | (F.col("__s") > F.col(score)))
    return known.join(o, beats, "left_anti")


def quartile_bins(rows: DataFrame, value: str, by: str, out: str = "quartile") -> DataFrame:
    """Quartile by value edges within groups, closed on the right, equal edges merged.

    Edges come from one aggregate and a join, not from a window over all rows of a group.
    """
    edges = rows.where(F.col(value).isNotNull()).groupBy(by).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("__q"))
    binned = F.when(F.col(value) <= F.get("__q", F.lit(0)), 1).when(F.col(value) <= F.get("__q", F.lit(1)), 2).when(F.col(value) <= F.get("__q", F.lit(2)), 3).when(F.col(value).isNotNull(), 4)
    return rows.join(edges, by, "left").withColumn(out, binned).drop("__q")


def z_scored(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Mean 0, sample deviation 1, from one aggregate that is joined back."""
    stats = rows.agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"__s_{c}") for c in columns])
    joined = rows.join(F.broadcast(stats))  # one row
    return joined.select(*rows.columns, *[((F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).alias(f"z_{c}") for c in columns])


def interleaved(items: DataFrame, group: list[str], section_rank: str, priority: str, out: str = "rank") -> DataFrame:
    """Ranked sections of a response merged by turns."""
    return items.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(section_rank, priority)))


def latest_attempt(attempts: DataFrame, key: list[str], attempt: str) -> DataFrame:
    """W10."""
    kept = [c for c in attempts.columns if c not in key]
    return attempts.groupBy(*key).agg(F.max_by(F.struct(*kept), attempt).alias("__r")).select(*key, "__r.*")


def keep_first(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row with the least ``order`` of each key."""
    kept = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*kept), order).alias("__r")).select(*key, "__r.*")


def keep_last(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """U6."""
    return latest_attempt(rows, key, order)


def top_counts(rows: DataFrame, item: str, k: int, order: str) -> DataFrame:
    """The k most frequent items, first seen first among equals."""
    return rows.groupBy(item).agg(F.count("*").alias("n"), F.min(order).alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(k)


def fingerprinted_subset(rows: DataFrame, key: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows with the least ids as text, and the hash of these ids."""
    subset = rows.withColumn("__id", F.col(key).cast("string")).orderBy("__id").limit(limit)
    mark = subset.agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("__id")), "\n"), 256), 1, 16).alias("fingerprint"), F.count("*").alias("n"))
    return subset.drop("__id"), mark
