"""Records: normalising exports, joining spans, auditing trials and releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


# --- normalisation ------------------------------------------------------------------------------------------
def strict_number(value: Column) -> Column:
    """A JSON number or boolean as a double, from a VARIANT; strings are no numbers."""
    kind = F.schema_of_variant(value)
    numeric = kind.rlike("^(BIGINT|DOUBLE|DECIMAL|INT|TINYINT|SMALLINT|FLOAT)")
    return F.when(numeric, F.try_variant_get(value, "$", "double")).when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double"))


def first_text(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in columns])


def normalize_records(exports: DataFrame, score: str) -> DataFrame:
    """Canonical analysis rows from export records with VARIANT columns.

    ``exports``: score, scores, metadata, metrics, output and input as VARIANT; condition, task_key, dataset_record_id,
    dataset_row_id as strings; line_no.  Rows without score, key or condition are dropped.
    """
    meta = lambda p: F.try_variant_get("metadata", f"$.{p}", "string")
    metric = lambda p: strict_number(F.try_variant_get("metrics", f"$.{p}", "variant"))
    value = F.coalesce(strict_number(F.col("score")), strict_number(F.try_variant_get("scores", f"$.{score}", "variant")))
    arm = F.when(first_text(meta("search_mode")) == "none", "no_search").otherwise(F.concat_ws("-", first_text(meta("provider")), first_text(meta("arm"))))
    condition = first_text(F.col("condition"), meta("condition_id"), F.concat(F.coalesce(first_text(meta("model")), F.lit("model")), F.lit("::"), F.coalesce(F.nullif(arm, F.lit("")), F.lit("no_search"))))
    question = F.coalesce(F.try_variant_get("input", "$.question", "string"), F.lit(""))
    answer = F.try_variant_get("output", "$.final_answer", "string")
    rows = exports.select(
        T.question_key(meta("task_key"), [F.col("task_key"), F.col("dataset_record_id"), F.col("dataset_row_id")], question).alias("task_key"),
        condition.alias("condition"),
        first_text(meta("study_id")).alias("study_id"),
        first_text(meta("dataset_name")).alias("dataset_name"),
        first_text(meta("dataset_version")).alias("dataset_version"),
        F.coalesce(first_text(meta("benchmark_category"), meta("category"), meta("topic"), meta("domain")), F.lit("uncategorized")).alias("category"),
        value.alias("score"),
        F.coalesce(metric("used_searches"), strict_number(F.try_variant_get("output", "$.used_searches", "variant")), strict_number(F.try_variant_get("metadata", "$.used_searches", "variant"))).alias("searches"),
        F.coalesce(metric("answer_words"), T.word_count(answer).cast("double")).alias("answer_words"),
        metric("total_cost_usd").alias("total_cost_usd"),
        "line_no",
    )
    return rows.where("score is not null and task_key is not null and condition is not null")


def single_valued(rows: DataFrame, column: str) -> DataFrame:
    """Raise when the non-null values of ``column`` are more than one."""
    one = rows.agg(F.countDistinct(column).alias("n"))
    guard = one.select(F.when(F.col("n") > 1, F.raise_error(F.lit(f"more than one {column}"))).otherwise(F.lit(True)).cast("boolean").alias("__ok"))
    return rows.join(F.broadcast(guard)).where("__ok is null or __ok").drop("__ok")


def merged_scores(rows: DataFrame, maps: list[DataFrame], keys: list[str], names: list[str]) -> DataFrame:
    """Left joins of score maps; a later map that has a key overrides, by a null too.

    Each map: keys and ``scores`` (map of doubles), one row a key (S15 makes it so).
    """
    out = rows
    for n, m in enumerate(maps):
        out = out.join(m.select(*keys, F.col("scores").alias(f"__m{n}")), keys, "left")
    for name in names:
        value = F.lit(None).cast("double")
        for n in range(len(maps)):
            value = F.when(F.map_contains_key(F.coalesce(f"__m{n}", F.create_map().cast("map<string,double>")), name), F.element_at(f"__m{n}", name)).otherwise(value)
        out = out.withColumn(name, value)
    return out.drop(*[f"__m{n}" for n in range(len(maps))])


def last_by_key(records: DataFrame, keys: list[str], payload: str, order: str = "line_no") -> DataFrame:
    """Score and metric maps: the last record of a key wins."""
    return records.groupBy(*keys).agg(F.max_by(payload, order).alias(payload))


def eligible(rows: DataFrame, search_treated: bool = True, intent_to_treat: bool = False) -> DataFrame:
    """Rows that can be judged (P6); ``intent_to_treat`` keeps rows whose search did nothing (O1)."""
    keep = ~F.col("refused") & ~F.col("truncated")
    if search_treated and not intent_to_treat:
        keep = keep & ~((F.col("arm") != "No search") & (F.col("zero_search") | F.col("search_failed")))
    return rows.where(keep)


def exclusion_ledger(rows: DataFrame, by: str = "arm") -> DataFrame:
    """Rows lost to each rule, by arm (O2)."""
    rules = ["refused", "truncated", "zero_search", "search_failed"]
    return rows.groupBy(by).agg(F.count("*").alias("n"), *[F.count_if(F.col(r)).alias(r) for r in rules], *[F.avg(F.col(r).cast("double")).alias(f"{r}_rate") for r in rules])


def question_features(rows: DataFrame, question: str = "question", age: str = "event_age_days") -> DataFrame:
    """Word counts, centred terms, years, scope words and age bins of questions."""
    q = F.coalesce(question, F.lit(""))
    words = T.word_count(q)
    stats = rows.agg(F.avg(words).alias("__w"), F.avg(age).alias("__a"))  # one row
    scope = r"\b(?:as of|between|during|since|before|after|from|through|within|by the time|over the course|elapsed)\b"
    named = r"\b(?:according to|official|reported by|coverage|article|statement|website|database|report|results|records|data)\b"
    years = F.size(F.array_distinct(F.regexp_extract_all(q, F.lit(r"\b20\d{2}\b"), 0)))
    a = F.col(age)
    return rows.join(F.broadcast(stats)).select(
        *rows.columns,
        words.alias("question_words"),
        ((words - F.col("__w")) / 10).alias("q_words_10"),
        ((a - F.col("__a")) / 90).alias("age_90"),
        F.when(years >= 2, 1).otherwise(0).alias("multi_year"),
        F.when(F.lower(q).rlike(scope), 1).otherwise(0).alias("temporal_scope"),
        F.when(F.lower(q).rlike(named), 1).otherwise(0).alias("source_constrained"),
        F.when((a >= 0) & (a <= 275), "Newest: 8–9 mo").when((a > 275) & (a <= 335), "10–11 mo").when((a > 335) & (a <= 400), "12–13 mo").when((a > 400) & (a <= 999), "Oldest: 14–16 mo").alias("age_bin"),
    )


# --- spans and trials ---------------------------------------------------------------------------------------
def is_dataset_root(row: str = "") -> Column:
    """P12."""
    return (F.col("origin.object_type") == "dataset") & (F.coalesce("origin.id", F.lit("")) != "")


def merged_score_spans(spans: DataFrame, order: str = "line_no") -> DataFrame:
    """Score maps of scorer spans merged by root, later spans override."""
    entries = spans.where("scores is not null").select("root_span_id", order, F.explode("scores").alias("name", "value"))
    last = entries.groupBy("root_span_id", "name").agg(F.max_by(F.struct("value"), order).alias("v"))
    return last.groupBy("root_span_id").agg(F.map_from_entries(F.collect_list(F.struct("name", F.col("v.value").alias("value")))).alias("scores"))


def export_roots(roots: DataFrame, scorer_spans: DataFrame, task_spans: DataFrame, required: list[str]) -> DataFrame:
    """Complete dataset roots with merged scores and their task's metrics.

    All required score names must be there, null or not; a second task span of a root is an error.
    """
    scores = merged_score_spans(scorer_spans)
    tasks = task_spans.groupBy("root_span_id").agg(F.count("*").alias("__n"), F.any_value("metrics").alias("task_metrics"))
    tasks = tasks.select("root_span_id", F.when(F.col("__n") > 1, F.raise_error(F.lit("more than one task span"))).otherwise(F.col("task_metrics")).alias("task_metrics"))
    need = F.array(*map(F.lit, required))
    joined = roots.where(is_dataset_root()).drop("scores").join(scores, "root_span_id").where(F.size(F.array_except(need, F.map_keys("scores"))) == 0)
    overlay = F.map_from_entries(F.concat(F.filter(F.map_entries(F.coalesce("metrics", F.create_map().cast("map<string,double>"))), lambda e: ~F.map_contains_key(F.coalesce("task_metrics", F.create_map().cast("map<string,double>")), e["key"])), F.map_entries(F.coalesce("task_metrics", F.create_map().cast("map<string,double>")))))
    return joined.join(tasks, "root_span_id", "left").withColumn("metrics", overlay).drop("task_metrics")


def completed_trials(roots: DataFrame, row: str = "row_id") -> DataFrame:
    """A12."""
    return roots.groupBy(row).agg(F.count("*").alias("done"))


def remaining_trials(rows: DataFrame, done: DataFrame, trials: int, row: str = "row_id") -> DataFrame:
    """Trials that rows still need."""
    left = F.greatest(F.lit(trials) - F.least(F.coalesce("done", F.lit(0)), F.lit(trials)), F.lit(0))
    return rows.join(done, row, "left").withColumn("remaining", left.cast("bigint")).where("remaining > 0").drop("done")


def trial_audit(expected: DataFrame, done: DataFrame, trials: int, row: str = "row_id") -> DataFrame:
    """Rows with missing, surplus or unknown trials."""
    both = expected.select(row).distinct().withColumn("__e", F.lit(True)).join(done, row, "full")
    n = F.coalesce("done", F.lit(0))
    return both.select(row, n.cast("bigint").alias("done"), F.when(F.col("__e").isNull(), "unknown").when(n < trials, "missing").when(n > trials, "duplicate").alias("problem")).where("problem is not null")


def error_summary(rows: DataFrame, error: str = "error") -> DataFrame:
    """Failed, total and rate; no rows count as rate 1."""
    agg = rows.agg(F.count_if(F.coalesce(error, F.lit("")) != "").alias("failed"), F.count("*").alias("total"))
    return agg.withColumn("rate", F.when(F.col("total") > 0, F.col("failed") / F.col("total")).otherwise(1.0))


def result_gate(rows: DataFrame, expected: int, most: float, error: str = "error") -> DataFrame:
    """Whether a run has its rows and few enough errors (Q4)."""
    return error_summary(rows, error).withColumn("passed", (F.col("total") == expected) & (F.col("rate") <= most))


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join that fails when a key repeats on either side."""
    def checked(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        g = df.groupBy(*keys).agg(F.count("*").alias("__n"), F.any_value(F.struct(*rest)).alias("__r"))
        return g.select(*keys, F.when(F.col("__n") > 1, F.raise_error(F.lit("a key repeats"))).otherwise(F.col("__r")).alias("__r")).select(*keys, "__r.*")

    return checked(left).join(checked(right), keys)


def unique_or_fail(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows as they are, or an error when a key repeats."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return rows.withColumn("__n", n).withColumn("__n", F.when(F.col("__n") > 1, F.raise_error(F.concat_ws(" ", F.lit("repeated key"), *keys))).otherwise(F.col("__n"))).where("__n = 1").drop("__n")


# --- results grain, cost and funnels ------------------------------------------------------------------------
def result_grain(rows: DataFrame, keep_text: bool = False) -> DataFrame:
    """One row a search result, with hashes in place of texts."""
    s = rows.select("row_id", F.posexplode("output.trajectory").alias("step_pos", "s"))
    r = s.select("row_id", "step_pos", F.col("s.tokens").alias("step_tokens"), F.size("s.results").alias("n_results_in_step"), F.posexplode("s.results").alias("result_pos", "r"))
    texts = [F.col("r.title").alias("title"), F.col("r.snippet").alias("snippet")] if keep_text else []
    return r.select("row_id", "step_pos", "result_pos", F.col("r.rank").alias("rank"), F.col("r.url").alias("url"), T.host(F.col("r.url")).alias("host"), T.authority(F.col("r.url")).alias("authority"), T.short_hash(F.coalesce("r.snippet", F.lit(""))).alias("snippet_hash"), F.length("r.snippet").alias("snippet_chars"), "step_tokens", "n_results_in_step", *texts)


def priced(rows: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """Model cost from a small price table (model, input_usd, output_usd); null and unconfirmed without a price."""
    p = prices.select(F.col("model").alias(model), "input_usd", "output_usd")
    cost = T.model_cost(F.col("input_usd"), F.col("output_usd"), F.col(model), F.col("prompt_tokens"), F.col("completion_tokens"), F.col("cached_tokens"))
    return rows.join(p, model, "left").withColumn("model_usd", cost).withColumn("cost_confirmed", F.col("input_usd").isNotNull()).drop("input_usd", "output_usd")


def search_histogram(rows: DataFrame, by: list[str], searches: str, judged: str, cap: int = 5) -> DataFrame:
    """Rows and accuracy by number of searches, and the share at the cap."""
    n = F.least(F.col(searches), F.lit(cap)).alias("searches")
    return rows.groupBy(*by, n).agg(F.count("*").alias("n"), F.avg(judged).alias("accuracy"))


def funnel(rows: DataFrame, by: list[str], stages: list[str]) -> DataFrame:
    """Rows that pass all stages up to each one; a stage never observed is null."""
    out, so_far = [], F.lit(True)
    for s in stages:
        so_far = so_far & F.coalesce(F.col(s), F.lit(False))
        out.append(F.when(F.count(s) > 0, F.count_if(so_far)).alias(s))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *out)


def concentration(rows: DataFrame, by: list[str], domain: str) -> DataFrame:
    """Domains, and the share of the first and the first five of them."""
    counts = rows.where(F.col(domain) != "").groupBy(*by, domain).agg(F.count("*").alias("n"))
    placed = counts.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), domain)))
    return placed.groupBy(*by).agg(F.count("*").alias("domains"), F.sum("n").alias("results"), (F.sum(F.when(F.col("at") == 1, F.col("n"))) / F.sum("n")).alias("top1"), (F.sum(F.when(F.col("at") <= 5, F.col("n"))) / F.sum("n")).alias("top5"), (F.sum(F.when(F.col("n") > 1, F.col("n"))) / F.sum("n")).alias("repeated"))


def cost_table(rows: DataFrame, by: list[str], cost: str, judged: str) -> DataFrame:
    """Median, 95th percentile, maximum and cost by correct answer."""
    return rows.groupBy(*by).agg(F.percentile(cost, 0.5).alias("median_cost"), F.percentile(cost, 0.95).alias("p95_cost"), F.max(cost).alias("max_cost"), F.try_divide(F.sum(cost), F.sum(judged)).alias("cost_per_correct"))


def routed(rows: DataFrame, task: str, arm: str, chosen: Column, score: str, cost: str) -> DataFrame:
    """What a router that picks one arm for each task would score and cost."""
    return rows.where(F.col(arm) == chosen).groupBy(task).agg(F.avg(score).alias("s"), F.avg(cost).alias("c")).agg(F.count("*").alias("tasks"), F.avg("s").alias("score"), F.sum("c").alias("cost"))


def disagreements(rows: DataFrame, by: list[str], visible: str, judged: str, matched: str) -> DataFrame:
    """O9."""
    return rows.groupBy(*by).agg(F.count_if((F.col(visible) == 1) & (F.col(judged) == 0)).alias("visible_but_wrong"), F.count_if((F.col(judged) == 1) & (F.col(matched) == 0)).alias("judge_right_match_wrong"))


def failed_by_all(rows: DataFrame, task: str, model: str, judged: str, models: int) -> DataFrame:
    """O10."""
    return rows.groupBy(task).agg(F.countDistinct(model).alias("models"), F.max(judged).alias("best")).where((F.col("models") == models) & (F.col("best") == 0)).select(task, "models")


def repeat_variance(rows: DataFrame, task: str, score: str) -> DataFrame:
    """O11."""
    return rows.groupBy(task).agg(F.count("*").alias("trials"), F.stddev_samp(score).alias("deviation"))


# --- release audit ------------------------------------------------------------------------------------------
#: Fixed: columns that must never be published.
BANNED = ["final_answer", "stripped_markdown", "articles", "snippet", "snippets", "root_span_id", "object_id", "_xact_id", "raw_content", "page_content", "answer", "output", "results", "documents"]


def audit_release(rows: DataFrame, unique: str, not_null: list[str], free_text: list[str], cell: list[str], expected_rows: int | None = None) -> DataFrame:
    """All problems of a table before it is published, a row each (Q1); one aggregate for the values, one for cells."""
    texts = [f.name for f in rows.schema.fields if f.dataType.simpleString() == "string" and f.name not in free_text]
    checks = [(f"url in {c}", F.count_if(F.col(c).rlike("https?://"))) for c in texts] + [(f"long text in {c}", F.count_if(F.length(c) > 120)) for c in texts]
    checks += [(f"null {c}", F.count_if(F.col(c).isNull())) for c in not_null]
    checks += [(f"repeated {unique}", F.count("*") - F.countDistinct(unique))]
    if expected_rows is not None:
        checks.append(("row count", F.abs(F.count("*") - F.lit(expected_rows))))
    found = rows.agg(*[c.cast("bigint").alias(str(n)) for n, (_, c) in enumerate(checks)])
    each = F.array(*[F.struct(F.lit(name).alias("problem"), F.col(str(n)).alias("n")) for n, (name, _) in enumerate(checks)])
    banned = [F.struct(F.lit(f"banned column {c}").alias("problem"), F.lit(1).cast("bigint").alias("n")) for c in rows.columns if c in BANNED]
    out = found.select(F.explode(F.concat(each, F.array(*banned)) if banned else each).alias("p")).select("p.*").where("n > 0")
    cells = rows.groupBy(*cell).agg(F.count("*").alias("c")).agg((F.max("c") - F.min("c")).alias("n")).where("n > 0").select(F.lit("unbalanced cells").alias("problem"), "n")
    return out.unionByName(cells)


# --- projections --------------------------------------------------------------------------------------------
def compact_record(events: DataFrame, task_metrics: str = "task_metrics") -> DataFrame:
    """Export records of events: articles out of the metadata, three keys of the output, the task's metrics over the
    root's own (P7).  ``metadata`` and ``output`` are structs."""
    empty = F.create_map().cast("map<string,double>")
    own, task = F.coalesce("metrics", empty), F.coalesce(task_metrics, empty)
    merged = F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key(task, k)), task)
    kept = [c for c in ("final_answer", "trajectory", "used_searches") if c in events.schema["output"].dataType.names]
    out = events.withColumn("metrics", merged).withColumn("output", F.struct(*[F.col(f"output.{c}").alias(c) for c in kept]))
    if "articles" in events.schema["metadata"].dataType.names:
        out = out.withColumn("metadata", F.col("metadata").dropFields("articles"))
    return out.drop(task_metrics)


def release_table(rows: DataFrame, drop: list[str] | None = None) -> DataFrame:
    """What may be published of variable rows: a hashed row id, no texts or span ids, latency from start and end where
    it is missing (P8)."""
    gone = set(drop or BANNED)
    latency = [F.coalesce("latency_s", F.col("end") - F.col("start")).alias("latency_s")] if {"latency_s", "start", "end"} <= set(rows.columns) else []
    kept = [c for c in rows.columns if c not in gone and not (latency and c in ("latency_s", "start", "end"))]
    return rows.select(T.row_id(F.col("task_key"), F.col("condition"), F.col("dataset_row_id")).alias("row_id"), *kept, *latency)


def without_incomplete(events: DataFrame, roots: DataFrame) -> DataFrame:
    """Events of complete roots alone, before a rerun (X11)."""
    return events.join(roots.select("root_span_id").distinct(), "root_span_id", "left_semi")
