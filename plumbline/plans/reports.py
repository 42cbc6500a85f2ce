"""Whole analyses: export records to a report; facts to rows and a ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import paired, records, resampling
from ..sources.writers import markdown


def paired_report(rows: DataFrame, baseline: str, rounds: int = 2000) -> str:
    """Condition summary, frontier and paired effects of canonical rows as Markdown (entry A).

    One study and one dataset version are required; what is collected has a row a condition.
    """
    rows = records.single_valued(records.single_valued(rows, "study_id"), "dataset_version")
    trials = paired.aggregate_trials(rows, ["score", "searches", "answer_words", "total_cost_usd"]).cache()
    summary = paired.condition_summary(trials, ["condition"], ["score", "searches", "answer_words", "total_cost_usd"])
    frontier = paired.pareto(summary, "total_cost_usd_mean", "score_mean", "condition")
    names = [r.condition for r in summary.select("condition").orderBy("condition").collect()]
    tables = {"Conditions": summary.orderBy("condition").toPandas(), "Frontier": frontier.select("condition").orderBy("condition").toPandas()}
    contrasts = [(n, baseline) for n in names if n != baseline]
    if contrasts:
        differences = paired.paired_differences(trials, contrasts).cache()
        bounds = paired.cluster_bootstrap(differences, ["contrast"], "diff", "task_key", rounds)
        effects = paired.paired_effects(differences).join(bounds.select("contrast", "ci_low", "ci_high"), "contrast").orderBy("contrast")
        tables["Paired effects"] = effects.toPandas()
        differences.unpersist()
    trials.unpersist()
    return markdown("Paired analysis", tables)


#: The descriptive tables of variable rows, each with its keys.
FIGURES = {
    "age_rates": ["arm", "model", "age_bin"],
    "latency_quartiles": ["model", "quartile"],
    "question_types": ["arm", "question_type"],
    "scorer_rates": ["arm"],
    "visibility": ["model", "visible"],
    "model_arm": ["model", "arm"],
}


def variable_tables(rows: DataFrame, outcomes: list[str], rounds: int = 5000, cluster: str = "task_key", **how) -> DataFrame:
    """All of ``FIGURES`` whose keys ``rows`` has, with intervals over clusters, in one pass over the eligible rows."""
    have = {n: k for n, k in FIGURES.items() if set(k) <= set(rows.columns)}
    return resampling.figure_tables(rows, have, outcomes, cluster, rounds, **how)


def age_gains(rows: DataFrame, arm: str, baseline: str, outcome: str, rounds: int = 5000, **how) -> DataFrame:
    """The gain of an arm over the baseline on the tasks that both have, by model and age bin."""
    of = lambda a: F.avg(F.when(F.col("arm") == a, F.col(outcome)))
    wide = rows.where("age_bin is not null").groupBy("model", "age_bin", "task_key").agg((of(arm) - of(baseline)).alias("diff")).where("diff is not null")
    return resampling.intervals(wide.select(F.concat_ws("|", "model", "age_bin").alias("contrast"), "task_key", "diff"), rounds, **how)


def frontier_without_open_with(trials: DataFrame, open_with: str, frontier_without: str) -> DataFrame:
    """An open model with retrieval against a frontier model without it, on common tasks, with cost (O3)."""
    d = paired.paired_differences(trials, [(open_with, frontier_without)])
    cost = trials.where(F.col("condition").isin(open_with, frontier_without)).groupBy("condition").agg(F.avg("total_cost_usd").alias("cost"))
    wide = cost.agg(F.max(F.when(F.col("condition") == open_with, F.col("cost"))).alias("cost_open"), F.max(F.when(F.col("condition") == frontier_without, F.col("cost"))).alias("cost_frontier"))
    return paired.paired_effects(d).join(F.broadcast(wide))
