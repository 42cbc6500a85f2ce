"""The library's operators applied to the driver's tables, each beside equivalent SQL.

``events`` serves as trials of conditions on tasks (task = user, condition = type, score = value); ``pages`` as search
results in trajectories; ``orders`` and ``lineitem`` as filings and observations; ``documents`` with ``labels`` as judged answers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scorers as S
from ..functions import text as T
from ..functions.udfs import folded
from ..operators import containment, facts, models, multiplicity, paired, records

#: R14.
SCORER_ORDER = tuple(S.SCORERS)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


#: Result columns of floating point, which engines sum in different orders: both sides round them to six places.
FLOATS: dict[str, list[str]] = {
    "trial_aggregation": ["score", "searches", "cost"],
    "condition_summary": ["score_mean", "cost_mean", "score_p95"],
    "nearest_rank_p95": ["p95"],
    "paired_differences": ["diff"],
    "paired_effects": ["effect", "category_balanced"],
    "reversed_effects": ["effect"],
    "category_effects": ["effect"],
    "pareto_frontier": ["score", "cost"],
    "difference_in_differences": ["effect"],
    "mediator_deltas": ["delta"],
    "model_arm_pivot": ["F", "O", "P"],
    "summary_grouping_sets": ["score"],
    "latency_quartiles": ["q"],
    "holm": ["p", "holm_p"],
    "benjamini_hochberg": ["p", "p_bh"],
    "corrections_one_family": ["holm_p", "p_bh"],
    "z_scores": ["s_acctbal", "z_s_acctbal"],
    "score_leakage_guard": ["leakage_guard"],
    "score_budget_economy": ["budget_economy"],
    "score_temporal_grounding": ["temporal_grounding"],
    "score_snippet_sufficiency": ["snippet_sufficiency"],
    "score_evidence_precision": ["evidence_precision"],
    "score_dealbreaker_gate": ["dealbreaker_gate"],
    "score_domain_entropy": ["domain_entropy"],
    "score_token_discounted_gain": ["token_discounted_gain"],
    "median_publication_lag": ["lag"],
    "domain_concentration": ["top1", "top5", "repeated"],
    "error_gate": ["rate"],
    "search_histogram": ["searches", "accuracy"],
    "cost_table": ["median_cost", "p95_cost", "max_cost", "cost_per_correct"],
    "router_simulation": ["score", "cost"],
    "repeat_variance": ["deviation"],
    "model_costs": ["model_usd"],
    "ols_slope": ["intercept", "slope"],
}


def q(column: str) -> str:
    return f'"{column}"'


def bound(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        floats = FLOATS.get(name, [])

        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            return out.select(*[F.round(c, 6).alias(c) if c in floats else F.col(c) for c in out.columns])

        QUERIES[name] = query
        if sql:
            SQL[name] = f"SELECT * REPLACE ({', '.join(f'round({q(c)}, 6) AS {q(c)}' for c in floats)}) FROM ({sql})" if floats else sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- trials -------------------------------------------------------------------------------------------------
def event_rows(spark, d) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, d, "events").select(
        F.col("user_id").alias("task_key"), F.col("event_type").alias("condition"), F.col("value").alias("score"), F.concat(F.lit("c"), k % 7).alias("category"),
        (k % 6).cast("double").alias("searches"), (F.col("value") / 100).alias("cost"), F.col("event_id").alias("line_no"),
    )


ROWS = """e AS (SELECT user_id AS task_key, event_type AS condition, value AS score, 'c' || (json_extract(props, '$.k')::INT % 7) AS category,
 (json_extract(props, '$.k')::INT % 6)::DOUBLE AS searches, value / 100 AS cost, event_id AS line_no FROM events)"""
TRIALS = ROWS + """, t AS (SELECT task_key, condition, avg(score) AS score, avg(searches) AS searches, avg(cost) AS cost,
 arg_min(category, line_no) AS category, count(*) AS trials FROM e GROUP BY 1, 2)"""


def trials(spark, d) -> DataFrame:
    return paired.aggregate_trials(event_rows(spark, d), ["score", "searches", "cost"])


def event_types(spark, d) -> list[tuple[str, str]]:
    """Contrasts of all conditions with the first."""
    names = sorted(r[0] for r in read(spark, d, "events").select("event_type").distinct().collect())
    return [(n, names[0]) for n in names[1:]]


PAIRS = TRIALS + """, b AS (SELECT min(event_type) AS base FROM events),
 p AS (SELECT x.condition || ' - ' || y.condition AS contrast, x.task_key, y.category, x.score - y.score AS diff
       FROM t x JOIN t y USING (task_key) JOIN b ON y.condition = b.base WHERE x.condition != b.base)"""


@bound("trial_aggregation", f"WITH {TRIALS} SELECT * FROM t")
def q_trials(spark, d):
    return trials(spark, d)


@bound("condition_summary", f"WITH {ROWS} SELECT condition, count(*) AS rows, count(DISTINCT task_key) AS tasks, avg(score) AS score_mean, avg(cost) AS cost_mean, quantile_cont(score, 0.95) AS score_p95 FROM e GROUP BY 1")
def q_summary(spark, d):
    return paired.condition_summary(event_rows(spark, d), ["condition"], ["score", "cost"], p95="score")


@bound("nearest_rank_p95", f"WITH {ROWS}, r AS (SELECT condition, list_sort(list(score)) AS s FROM e GROUP BY 1) SELECT condition, s[(round_even((len(s) - 1) * 0.95, 0) + 1)::INT] AS p95 FROM r")
def q_nearest(spark, d):
    return paired.nearest_rank_by(event_rows(spark, d), "condition", "score", 0.95).withColumnRenamed("p_value", "p95")


@bound("paired_differences", f"WITH {PAIRS} SELECT contrast, task_key, category, diff FROM p")
def q_differences(spark, d):
    return paired.paired_differences(trials(spark, d), event_types(spark, d))


EFFECTS = PAIRS + """, f AS (SELECT contrast, count(*) AS n, avg(diff) AS effect, count(*) FILTER (diff > 0) AS wins, count(*) FILTER (diff = 0) AS ties, count(*) FILTER (diff < 0) AS losses FROM p GROUP BY 1),
 cb AS (SELECT contrast, avg(m) AS category_balanced FROM (SELECT contrast, category, avg(diff) AS m FROM p GROUP BY 1, 2) GROUP BY 1)"""


@bound("paired_effects", f"WITH {EFFECTS} SELECT f.*, category_balanced FROM f JOIN cb USING (contrast)")
def q_effects(spark, d):
    return paired.paired_effects(paired.paired_differences(trials(spark, d), event_types(spark, d)))


@bound("reversed_effects", f"WITH {EFFECTS} SELECT contrast, n, -effect AS effect, losses AS wins, ties, wins AS losses FROM f")
def q_reversed(spark, d):
    return paired.reversed_effects(q_effects(spark, d).drop("category_balanced"))


@bound("category_effects", f"WITH {PAIRS} SELECT contrast, category, count(*) AS n, avg(diff) AS effect FROM p GROUP BY 1, 2 HAVING count(*) >= 10")
def q_category(spark, d):
    return paired.category_effects(paired.paired_differences(trials(spark, d), event_types(spark, d)))


@bound("cluster_bootstrap")
def q_cluster_bootstrap(spark, d):
    return paired.cluster_bootstrap(event_rows(spark, d), ["condition"], "score", "task_key")


@bound("pareto_frontier", f"WITH {TRIALS}, s AS (SELECT condition, avg(score) AS score, avg(cost) AS cost FROM t GROUP BY 1) SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.cost <= s.cost AND o.score >= s.score AND (o.cost < s.cost OR o.score > s.score))")
def q_pareto(spark, d):
    return paired.pareto(trials(spark, d).groupBy("condition").agg(F.avg("score").alias("score"), F.avg("cost").alias("cost")), "cost", "score", "condition")


ORDERS = "o AS (SELECT c_custkey AS task_key, o_orderpriority AS model, o_orderstatus AS arm, c_mktsegment AS category, o_totalprice AS score, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey)"


def order_rows(spark, d) -> DataFrame:
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_custkey").alias("task_key"), F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("arm"), F.col("c_mktsegment").alias("category"), F.col("o_totalprice").alias("score"), "o_orderkey")


GAINS = ORDERS + """, g AS (SELECT model, task_key, avg(score) FILTER (arm = 'F') - avg(score) FILTER (arm = 'O') AS gain FROM o GROUP BY 1, 2 HAVING gain IS NOT NULL)"""


@bound("difference_in_differences", f"WITH {GAINS} SELECT a.model AS model_a, b.model AS model_b, count(*) AS n, avg(a.gain - b.gain) AS effect FROM g a JOIN g b USING (task_key) WHERE a.model < b.model GROUP BY 1, 2")
def q_did(spark, d):
    arm = lambda a: F.avg(F.when(F.col("arm") == a, F.col("score")))
    gains = order_rows(spark, d).groupBy("model", "task_key").agg((arm("F") - arm("O")).alias("gain")).where("gain is not null")
    return paired.difference_in_differences(gains)


@bound("mediator_deltas", f"WITH {ROWS}, l AS (SELECT task_key, category, condition, 'searches' AS mediator, searches AS v FROM e UNION ALL SELECT task_key, category, condition, 'cost', cost FROM e), w AS (SELECT category, task_key, mediator, avg(v) FILTER (condition = 'purchase') AS a, avg(v) FILTER (condition = 'click') AS b FROM l GROUP BY 1, 2, 3) SELECT category, mediator, count(*) AS n, avg(a - b) AS delta FROM w WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2")
def q_mediators(spark, d):
    return paired.mediator_deltas(event_rows(spark, d), ["searches", "cost"], ["category"], "task_key", "condition", "purchase", "click")


@bound("model_arm_pivot", f"WITH {ORDERS} SELECT model, avg(score) FILTER (arm = 'F') AS \"F\", avg(score) FILTER (arm = 'O') AS \"O\", avg(score) FILTER (arm = 'P') AS \"P\" FROM o GROUP BY 1")
def q_pivot(spark, d):
    return order_rows(spark, d).groupBy("model").pivot("arm", ["F", "O", "P"]).agg(F.avg("score"))


@bound("summary_grouping_sets", f"WITH {ORDERS} SELECT model, arm, category, count(*) AS n, avg(score) AS score FROM o GROUP BY GROUPING SETS ((model, arm), (model), (category))")
def q_sets(spark, d):
    return order_rows(spark, d).groupingSets([["model", "arm"], ["model"], ["category"]], "model", "arm", "category").agg(F.count("*").alias("n"), F.avg("score").alias("score"))


LAT = "l AS (SELECT l_orderkey, l_linenumber, o_orderpriority AS model, date_diff('day', o_orderdate::DATE, l_shipdate::DATE)::DOUBLE AS latency, l_quantity AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def latencies(spark, d) -> DataFrame:
    li, o = read(spark, d, "lineitem"), read(spark, d, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", "l_suppkey", F.col("o_orderpriority").alias("model"), F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")).cast("double").alias("latency"), F.col("l_quantity").alias("q"))


@bound("latency_quartiles", f"WITH {LAT}, e AS (SELECT model, quantile_cont(latency, [0.25, 0.5, 0.75]) AS c FROM l GROUP BY 1) SELECT model, CASE WHEN latency <= c[1] THEN 1 WHEN latency <= c[2] THEN 2 WHEN latency <= c[3] THEN 3 ELSE 4 END AS quartile, count(*) AS n, avg(q) AS q FROM l JOIN e USING (model) GROUP BY 1, 2")
def q_quartiles(spark, d):
    return paired.quartile_bins(latencies(spark, d), "latency", "model").groupBy("model", "quartile").agg(F.count("*").alias("n"), F.avg("q").alias("q"))


PV = "pv AS (SELECT p_brand AS family, p_partkey AS test, ((p_partkey * 7919) % 9973 + 1) / 9974.0::DOUBLE AS p FROM part)"


def p_values(spark, d) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_brand").alias("family"), F.col("p_partkey").alias("test"), ((F.col("p_partkey") * 7919 % 9973 + 1) / F.lit(9974.0)).alias("p"))


@bound("holm", f"WITH {PV}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p) AS i, count(*) OVER (PARTITION BY family) AS m FROM pv) SELECT family, test, p, max(least(1.0::DOUBLE, (m - i + 1) * p)) OVER (PARTITION BY family ORDER BY i) AS holm_p FROM r")
def q_holm(spark, d):
    return multiplicity.holm(p_values(spark, d), "p", ["family"])


_ALL = "pv AS (SELECT o_orderkey AS test, ((o_orderkey * 7919) % 99991 + 1) / 99992.0::DOUBLE AS p FROM orders), r AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS m FROM pv)"


@bound("corrections_one_family", f"WITH {_ALL} SELECT test, max(least(1.0::DOUBLE, (m - i + 1) * p)) OVER (ORDER BY i) AS holm_p, least(1.0::DOUBLE, min(p * m / i) OVER (ORDER BY i DESC)) AS p_bh FROM r")
def q_one_family(spark, d):
    """One family of all rows."""
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("test"), ((F.col("o_orderkey") * 7919 % 99991 + 1) / F.lit(99992.0)).alias("p"))
    return multiplicity.corrections(rows, "p").drop("p")


@bound("benjamini_hochberg", f"WITH {PV}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p) AS i, count(*) OVER (PARTITION BY family) AS m FROM pv) SELECT family, test, p, least(1.0::DOUBLE, min(p * m / i) OVER (PARTITION BY family ORDER BY i DESC)) AS p_bh FROM r")
def q_bh(spark, d):
    return multiplicity.benjamini_hochberg(p_values(spark, d), "p", ["family"])


@bound("z_scores", "SELECT s_suppkey, s_acctbal, (s_acctbal - avg(s_acctbal) OVER ()) / stddev_samp(s_acctbal) OVER () AS z_s_acctbal FROM supplier")
def q_z(spark, d):
    return paired.z_scored(read(spark, d, "supplier").select("s_suppkey", "s_acctbal"), ["s_acctbal"])


@bound("interleaved_sections", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY sr, pr, o_orderkey) AS rank FROM (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END AS pr, row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'F' ORDER BY o_orderkey) AS sr FROM orders)")
def q_interleave(spark, d):
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("pr"))
    o = o.withColumn("sr", F.row_number().over(Window.partitionBy("o_custkey", "pr").orderBy("o_orderkey")))
    return o.select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("sr", "pr", "o_orderkey")).alias("rank"))


@bound("latest_attempt", "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def q_latest(spark, d):
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.col("o_orderkey").alias("k"))
    return paired.latest_attempt(o, ["o_custkey"], "k").drop("k")


@bound("keep_first_by_url", "SELECT url, min(page_id) AS page_id FROM pages GROUP BY 1")
def q_first(spark, d):
    return paired.keep_first(read(spark, d, "pages").select("url", "page_id", F.col("page_id").alias("k")), ["url"], "k").drop("k")


@bound("top_domains", "WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^www\\.', '') AS host FROM pages) SELECT host, count(*) AS n, min(page_id) AS first_seen FROM h GROUP BY 1 ORDER BY n DESC, first_seen LIMIT 12")
def q_top(spark, d):
    return paired.top_counts(read(spark, d, "pages").select(T.host(F.col("url")).alias("host"), "page_id"), "host", 12, "page_id")


@bound("subset_fingerprint", "WITH s AS (SELECT doc_id::VARCHAR AS i FROM documents ORDER BY i LIMIT 100) SELECT substr(sha256(string_agg(i, chr(10) ORDER BY i)), 1, 16) AS fingerprint, count(*) AS n FROM s")
def q_subset(spark, d):
    return paired.fingerprinted_subset(read(spark, d, "documents").select("doc_id"), "doc_id", 100)[1]


# --- trajectories -------------------------------------------------------------------------------------------
def trajectories(spark, d) -> DataFrame:
    """Pages as results: six pages a row, two for each of its three steps, with their whole texts as snippets (``FLAT``)."""
    n = F.col("page_id")
    p = read(spark, d, "pages").select(F.floor(n / 6).alias("row_id"), (n % 3).alias("step"), "page_id", "url", F.regexp_replace("html", "<[^>]*>", " ").alias("snippet"))
    inner = p.groupBy("row_id", "step").agg(F.array_sort(F.collect_list(F.struct("page_id", "url", "snippet"))).alias("r"), F.sum(F.length("url")).alias("used"))
    result = lambda x, i: F.struct(
        (i + 1).alias("rank"), x["url"].alias("url"), F.lit("").alias("title"), x["snippet"].alias("snippet"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (x["page_id"] % 300).cast("int")), "yyyy-MM-dd").alias("published_date"),
        F.lit("publication").alias("date_semantics"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("boolean").alias("oracle_snippet_gold"))
    step = F.struct("step", F.lit("search").alias("type"), ((F.col("step") + 1) * 1000.0).alias("tokens"), F.transform("r", result).alias("results"))
    rows = inner.groupBy("row_id").agg(F.array_sort(F.collect_list(step)).alias("trajectory"), F.sum("used").alias("used"))
    k = F.col("row_id")
    answer = F.when(k % 5 == 0, F.lit("The  REING!")).when(k % 5 == 1, "I could not find this.").when(k % 5 == 2, "it is keit, they say").when(k % 5 == 3, "").otherwise("a reingen keit")
    return rows.select(
        "row_id", F.array(F.when(k % 2 == 0, F.lit("reing")).otherwise(F.lit("keit"))).alias("expected"),
        F.struct(answer.alias("final_answer"), F.when(k % 7 == 0, "urls_only").when(k % 11 == 0, "none").otherwise("full").alias("decision_surface"), (F.col("used") % 8).cast("int").alias("used_searches"), F.lit(0).alias("used_clicks"), "trajectory").alias("output"),
        F.struct(F.lit(None).cast("string").alias("link"), F.array(F.struct(F.lit("https://tionsh.example.net/a").alias("link"), F.lit(None).cast("string").alias("url"))).alias("articles"), F.lit("2024-05-01").alias("event_date"), F.lit(None).cast("string").alias("date"), F.lit(None).cast("int").alias("search_budget"), F.lit(None).cast("array<string>").alias("answer_aliases")).alias("metadata"),
    )


FLAT = r"""x AS (SELECT page_id // 6 AS row_id, page_id % 3 AS step, page_id, url, lower(regexp_replace(html, '<[^>]*>', ' ', 'g')) AS txt,
 regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^www\.', '') AS host, DATE '2024-01-01' + (page_id % 300)::INT AS pub FROM pages),
 y AS (SELECT *, row_number() OVER (PARTITION BY row_id, step ORDER BY page_id) AS rank, contains(txt, CASE WHEN row_id % 2 = 0 THEN 'reing' ELSE 'keit' END) AS gold,
 sum(length(url)) OVER (PARTITION BY row_id) % 8 AS used, CASE WHEN row_id % 7 = 0 THEN 'urls_only' WHEN row_id % 11 = 0 THEN 'none' ELSE 'full' END AS surface FROM x)"""
_LEAKS = "bool_or(host = 'tionsh.example.net' OR ends_with(host, '.tionsh.example.net') OR host IN ('web.archive.org', 'archive.org'))"
_GATE = f"CASE WHEN any_value(surface) = 'none' THEN NULL ELSE least(CASE WHEN {_LEAKS} THEN 0.0 ELSE 1.0 END, CASE WHEN any_value(used) <= 5 THEN 1.0 ELSE 0.0 END) END::DOUBLE"
#: By row modulo 10: the answers of ``trajectories`` against the gold of even and odd rows.


def scored(*names: str) -> Query:
    return lambda spark, d: S.score(trajectories(spark, d), list(names)).select("row_id", *names)


for _name, _sql in {
    "leakage_guard": f"CASE WHEN any_value(surface) = 'none' THEN NULL ELSE CASE WHEN {_LEAKS} THEN 0.0 ELSE 1.0 END END::DOUBLE",
    "budget_economy": "CASE WHEN any_value(surface) = 'none' THEN NULL WHEN any_value(used) <= 5 THEN 1.0 ELSE 0.0 END::DOUBLE",
    "temporal_grounding": "CASE WHEN any_value(surface) = 'full' THEN 1.0::DOUBLE - count(*) FILTER (pub < DATE '2024-05-01') / count(*) END",
    "snippet_sufficiency": "CASE WHEN any_value(surface) = 'full' THEN CASE WHEN bool_or(gold) THEN 1.0 ELSE 0.0 END END::DOUBLE",
    "evidence_precision": "CASE WHEN any_value(surface) = 'full' THEN count(*) FILTER (gold) / count(*) END::DOUBLE",
}.items():
    bound(f"score_{_name}", f"WITH {FLAT} SELECT row_id, {_sql} AS {_name} FROM y GROUP BY row_id")(scored(_name))

bound("score_dealbreaker_gate", f"WITH {FLAT} SELECT row_id, {_GATE} AS dealbreaker_gate FROM y GROUP BY row_id")(scored("dealbreaker_gate"))

@bound("score_registry", "SELECT unnest(range(11))::INT AS position, unnest(['qa_answer_match', 'leakage_guard', 'budget_economy', 'dealbreaker_gate', 'gated_answer_match', 'temporal_grounding', 'snippet_sufficiency', 'evidence_precision', 'token_discounted_gain', 'compression_redundancy', 'domain_entropy']) AS name")
def q_registry(spark, d):
    """All scorers at once, in their order."""
    scored_rows = S.score(trajectories(spark, d))
    names = [c for c in scored_rows.columns if c in S.SCORERS]
    return spark.createDataFrame([(n, c) for n, c in enumerate(names[: len(SCORER_ORDER)])], "position int, name string")


@bound("trajectory_fields", f"WITH {FLAT} SELECT row_id, CASE WHEN row_id % 2 = 0 THEN 'reing' ELSE 'keit' END AS gold, any_value(surface) AS surface, 'tionsh.example.net' AS source_hosts, count(*) FILTER (host = 'tionsh.example.net' OR ends_with(host, '.tionsh.example.net')) > 0 AS leaks, least(10, count(*) FILTER (host = 'tionsh.example.net' OR ends_with(host, '.tionsh.example.net')))::INT AS first_leaks, CASE row_id % 5 WHEN 0 THEN 'The  REING!' WHEN 1 THEN 'I could not find this.' WHEN 2 THEN 'it is keit, they say' WHEN 3 THEN '' ELSE 'a reingen keit' END AS answer FROM y GROUP BY row_id")
def q_fields(spark, d):
    """F9 to F12, U7, T3."""
    leaked = S.leaked_urls()
    return trajectories(spark, d).select("row_id", F.array_join(S.golds(), "|").alias("gold"), S.surface().alias("surface"), F.array_join(S.source_hosts(), "|").alias("source_hosts"), (F.size(leaked) > 0).alias("leaks"), F.size(F.slice(leaked, 1, 10)).alias("first_leaks"), S.answer().alias("answer"))


bound("score_domain_entropy", f"WITH {FLAT}, c AS (SELECT row_id, any_value(surface) AS surface, host, count(*) AS c FROM y GROUP BY row_id, host), n AS (SELECT row_id, any_value(surface) AS surface, sum(c)::DOUBLE AS n, list(c) AS cs FROM c GROUP BY row_id) SELECT row_id, CASE WHEN surface != 'none' AND n >= 2 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, list_sum(list_transform(cs, lambda k: -(k / n) * ln(k / n))) / ln(n))) END AS domain_entropy FROM n")(scored("domain_entropy"))
bound("score_token_discounted_gain", f"WITH {FLAT}, s AS (SELECT *, (step + 1) * 1000.0::DOUBLE / count(*) OVER (PARTITION BY row_id, step) AS share FROM y), r AS (SELECT *, sum(share) OVER (PARTITION BY row_id ORDER BY step, rank) AS read FROM s) SELECT row_id, CASE WHEN any_value(surface) = 'full' THEN coalesce(exp(-min(read) FILTER (gold) / 4000.0::DOUBLE), 0.0) END AS token_discounted_gain FROM r GROUP BY row_id")(scored("token_discounted_gain"))
bound("score_compression_redundancy")(lambda spark, d: S.score(trajectories(spark, d), ["compression_redundancy"]).select("row_id", "compression_redundancy"))


@bound("best_gold_rank", f"WITH {FLAT} SELECT row_id, min(rank) FILTER (gold) AS rank, arg_min(step + 1, rank * 100 + step) FILTER (gold) AS round FROM y GROUP BY row_id")
def q_best_gold(spark, d):
    return trajectories(spark, d).select("row_id", S.best_gold().alias("b")).select("row_id", F.col("b.rank").cast("bigint").alias("rank"), F.col("b.round").cast("bigint").alias("round"))


@bound("median_publication_lag", f"WITH {FLAT}, l AS (SELECT row_id, list_sort(list(date_diff('day', DATE '2024-05-01', pub)::DOUBLE)) AS v FROM y GROUP BY 1) SELECT row_id, v[len(v) // 2 + 1] AS lag FROM l")
def q_lag(spark, d):
    return trajectories(spark, d).select("row_id", S.median_lag_days().alias("lag"))


@bound("surfaced_domains", f"WITH {FLAT} SELECT row_id, count(DISTINCT host)::INT AS domains FROM y GROUP BY 1")
def q_domains(spark, d):
    return trajectories(spark, d).select("row_id", S.surfaced_domains().alias("domains"))


@bound("result_grain", f"WITH {FLAT} SELECT row_id, rank::INT AS rank, url, host, substr(sha256(regexp_replace(html, '<[^>]*>', ' ', 'g')), 1, 16) AS snippet_hash FROM y JOIN pages USING (page_id, url)")
def q_grain(spark, d):
    return records.result_grain(trajectories(spark, d)).select("row_id", "rank", "url", "host", "snippet_hash")


@bound("domain_concentration", f"WITH {FLAT}, c AS (SELECT step, host, count(*) AS n FROM y GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY n DESC, host) AS pl FROM c) SELECT step, count(*) AS domains, sum(n)::BIGINT AS results, sum(n) FILTER (pl = 1) / sum(n) AS top1, sum(n) FILTER (pl <= 5) / sum(n) AS top5, sum(n) FILTER (n > 1) / sum(n) AS repeated FROM p GROUP BY 1")
def q_concentration(spark, d):
    p = read(spark, d, "pages").select((F.col("page_id") % 3).alias("step"), T.host(F.col("url")).alias("host"))
    return records.concentration(p, ["step"], "host")


@bound("apex_join", "WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host FROM pages), a(domain) AS (VALUES ('example.net'), ('tionsh.example.net'), ('thther.example.org')) SELECT domain, count(*) AS n FROM h JOIN a ON host = domain OR ends_with(host, '.' || domain) GROUP BY 1")
def q_apex(spark, d):
    pages = read(spark, d, "pages").select(F.explode(T.host_suffixes(T.host(F.col("url")))).alias("domain"))
    apex = spark.createDataFrame([("example.net",), ("tionsh.example.net",), ("thther.example.org",)], "domain string")
    return pages.join(apex, "domain").groupBy("domain").agg(F.count("*").alias("n"))


# --- texts --------------------------------------------------------------------------------------------------
_SHORT = "SELECT item_id, array_to_string(list_slice(regexp_extract_all(text, '[^ ]+'), 1, 1 + item_id % 2), ' ') AS text FROM benchmark"


@bound("short_gold_containment", f"SELECT item_id, count(*) AS hits FROM ({_SHORT}) b JOIN documents d ON contains(lower(d.text), lower(b.text)) GROUP BY 1")
def q_contains_short(spark, d):
    """Golds of one and two words."""
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit("[^ ]+"), F.lit(0)), F.lit(1), (1 + F.col("item_id") % 2).cast("int")), " ")
    golds = read(spark, d, "benchmark").select("item_id", first.alias("text"))
    return containment.containing(read(spark, d, "documents"), golds, "doc_id", "item_id").groupBy("item_id").agg(F.count("*").alias("hits"))


@bound("gold_containment", "SELECT item_id, count(*) AS hits FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text)) GROUP BY 1")
def q_contains(spark, d):
    """Documents that hold a whole benchmark text."""
    return containment.containing(read(spark, d, "documents"), read(spark, d, "benchmark"), "doc_id", "item_id").groupBy("item_id").agg(F.count("*").alias("hits"))


@bound("question_types", "SELECT doc_id, CASE WHEN " + " OR ".join(f"contains(lower(text), '{t}')" for t in T.QUANTITATIVE_RELEASE) + " THEN 'Quantitative / composed' ELSE 'Other factual' END AS kind FROM documents")
def q_question(spark, d):
    return read(spark, d, "documents").select("doc_id", T.question_type(F.col("text"), T.QUANTITATIVE_RELEASE).alias("kind"))


@bound("content_hashes", "SELECT substr(sha256(text), 1, 16) AS h, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def q_hashes(spark, d):
    return read(spark, d, "documents").groupBy(T.short_hash(F.col("text")).alias("h")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@bound("stable_ids", "SELECT doc_id, sha256('[\"' || source || '\",\"' || lang || '\",\"' || doc_id || '\"]') AS id, substr(sha256(source || '|' || lang || '|' || doc_id), 1, 16) AS row FROM documents")
def q_ids(spark, d):
    doc = read(spark, d, "documents")
    return doc.select("doc_id", T.json_id(F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("id"), T.row_id(F.col("source"), F.col("lang"), F.col("doc_id")).alias("row"))


@bound("token_estimates", "SELECT conv_id, turn, greatest(1, length(text) // 4)::BIGINT AS tokens, len(regexp_extract_all(text, '\\S+'))::INT AS words FROM conversations")
def q_tokens(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", T.token_estimate(F.col("text")).alias("tokens"), T.word_count(F.col("text")).alias("words"))


@bound("answer_normalization")
def q_normalized(spark, d):
    doc = read(spark, d, "documents").select("doc_id", folded()(F.col("text")).alias("f"))
    return doc.select("doc_id", F.sha2(T.normalized_answer(F.col("f")), 256).alias("normal"))


@bound("canonical_values", "SELECT p_partkey, trim(lower(p_name)) AS value FROM part")
def q_canonical(spark, d):
    return read(spark, d, "part").select("p_partkey", T.canonical_value(F.col("p_name")).alias("value"))


@bound("recency_rungs", "SELECT l_orderkey, l_linenumber, CASE WHEN h < 0 THEN 'future' WHEN h < 24 THEN 'lt_24h' WHEN h < 72 THEN '24h_72h' WHEN h < 168 THEN '3d_7d' WHEN h < 720 THEN '7d_30d' ELSE 'gte_30d' END AS rung FROM (SELECT l_orderkey, l_linenumber, date_diff('hour', l_shipdate::TIMESTAMP, o_orderdate::TIMESTAMP + INTERVAL 60 DAY) AS h FROM lineitem JOIN orders ON l_orderkey = o_orderkey)")
def q_rungs(spark, d):
    li, o = read(spark, d, "lineitem"), read(spark, d, "orders")
    as_of = F.date_add(F.col("o_orderdate").cast("date"), 60).cast("timestamp")
    return li.join(o, li.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", T.recency_rung(F.col("l_shipdate").cast("timestamp"), as_of).alias("rung"))


# --- facts --------------------------------------------------------------------------------------------------
@bound("pair_within_window", "WITH p AS (SELECT o.o_orderkey AS anchor, x.o_orderkey FROM orders o JOIN orders x ON o.o_custkey = x.o_custkey AND x.o_orderkey != o.o_orderkey AND x.o_orderdate::DATE BETWEEN o.o_orderdate::DATE - 14 AND o.o_orderdate::DATE + 45) SELECT o_orderkey, count(*)::INT AS n, min(anchor) AS first_anchor FROM p GROUP BY 1")
def q_pair(spark, d):
    """Orders of one customer near one another; keys are dealt by 60-day periods as well."""
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    got = facts.pair_within(o, o, "o_custkey", "o_orderdate", "o_orderdate", "o_orderkey", "o_orderkey", bin_days=60)
    others = F.filter("paired", lambda x: x != F.col("o_orderkey"))
    return got.withColumn("paired", others).where("size(paired) > 0").select("o_orderkey", F.size("paired").alias("n"), F.array_min("paired").alias("first_anchor"))


@bound("promotions", "WITH d AS (SELECT o_custkey, o_orderdate::DATE AS day, max(o_orderpriority) AS role FROM orders GROUP BY 1, 2), l AS (SELECT *, lag(role) OVER w AS previous, lag(day) OVER w AS pd FROM d WINDOW w AS (PARTITION BY o_custkey ORDER BY day)) SELECT o_custkey, strftime(day, '%Y-%m-%d') AS day, role, previous, strftime(pd, '%Y-%m-%d') AS previous_day FROM l WHERE previous != role")
def q_promotions(spark, d):
    o = read(spark, d, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderpriority").alias("role"))
    out = facts.promotions(o, ["o_custkey"], "day", "role")
    return out.select("o_custkey", F.date_format("day", "yyyy-MM-dd").alias("day"), "role", "previous", F.date_format("previous_day", "yyyy-MM-dd").alias("previous_day"))


def observations(spark, d) -> DataFrame:
    return read(spark, d, "lineitem").select(
        F.concat(F.lit("P"), "l_partkey").alias("entity_id"), F.concat(F.lit("Part "), "l_partkey").alias("entity_name"), F.lit("part").alias("entity_type"), F.lit("ceo_of").alias("attribute"),
        F.when((F.col("l_linenumber") > 4) & (F.col("l_partkey") % 3 == 0), F.lit("old")).alias("old_value"), F.col("l_returnflag").alias("new_value"), F.when(F.col("l_partkey") % 2 == 0, F.lit("1995-01-01").cast("timestamp")).otherwise(F.date_trunc("year", F.col("l_shipdate").cast("timestamp"))).alias("effective_ts"),
        F.col("l_shipdate").cast("timestamp").alias("observed_ts"), F.concat(F.lit("https://s"), "l_suppkey", F.lit(".example.org/")).alias("source_url"), F.lit("x").alias("source_type"),
        F.concat(F.lit("r"), F.col("l_suppkey") % 5).alias("resolver_id"), F.lit(None).cast("string").alias("attester_id"), F.concat(F.lit("a"), F.col("l_suppkey") % 3).alias("authority_family"),
        F.lit("s").alias("compliance_source_id"), F.lit(None).cast("array<string>").alias("aliases"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no"))


FACTS = """f AS (SELECT 'p' || l_partkey AS k, lower(l_returnflag) AS v, count(DISTINCT l_suppkey % 5) AS r, count(DISTINCT l_suppkey % 3) AS a,
 count(DISTINCT CASE WHEN l_partkey % 2 = 0 THEN 1995 ELSE year(l_shipdate) END) AS t, count(DISTINCT (l_linenumber > 4 AND l_partkey % 3 = 0)) AS op, count(*) AS n FROM lineitem GROUP BY 1, 2),
 j AS (SELECT *, list_filter([CASE WHEN r < 2 THEN 'insufficient_resolvers' END, CASE WHEN a < 2 THEN 'insufficient_attesters' END, CASE WHEN op > 1 THEN 'old_value_disagreement' END, CASE WHEN t > 1 THEN 'effective_ts_disagreement' END], lambda x: x IS NOT NULL) AS reasons FROM f)"""


@bound("fact_rows", f"WITH {FACTS} SELECT upper(k) AS entity_id, 'Who is the CEO of Part ' || substr(k, 2) || '?' AS question, v AS expected, r::INT AS resolvers, a::INT AS attesters FROM j WHERE len(reasons) = 0")
def q_facts(spark, d):
    rows, _ = facts.build_rows(observations(spark, d), "freeze", "dev")
    return rows.select("entity_id", "question", F.lower("expected").alias("expected"), F.size("resolver_ids").alias("resolvers"), F.size("attester_ids").alias("attesters"))


@bound("fact_rejections", f"WITH {FACTS} SELECT k || ':' || v AS key, array_to_string(reasons, ',') AS reasons, n AS observation_count FROM j WHERE len(reasons) > 0")
def q_rejections(spark, d):
    _, rejected = facts.build_rows(observations(spark, d), "freeze", "dev")
    return rejected.select(F.concat_ws(":", F.get("agreement_key", F.lit(0)), F.get("agreement_key", F.lit(2))).alias("key"), F.array_join("reasons", ",").alias("reasons"), "observation_count")


@bound("rejection_histogram", f"WITH {FACTS} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM j) GROUP BY 1")
def q_reasons(spark, d):
    return facts.reason_histogram(facts.build_rows(observations(spark, d), "freeze", "dev")[1])


@bound("trap_rows", "WITH t AS (SELECT o_custkey AS trap_id, count(DISTINCT o_orderpriority) AS r, arg_min(o_orderdate, (o_orderdate, o_orderkey)) AS due, count(DISTINCT o_orderstatus) AS q FROM orders GROUP BY 1), j AS (SELECT trap_id, list_filter([CASE WHEN r < 2 THEN 'insufficient_resolvers' END, CASE WHEN r < 2 THEN 'insufficient_attesters' END, CASE WHEN q != 1 THEN 'question_disagreement' END, CASE WHEN due <= TIMESTAMP '1996-01-01' + INTERVAL 7 DAY THEN 'resolves_inside_safety_window' END], lambda x: x IS NOT NULL) AS reasons FROM t) SELECT trap_id, array_to_string(reasons, ',') AS reasons FROM j WHERE len(reasons) > 0")
def q_traps(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("trap_id"), F.col("o_orderstatus").alias("question"), F.lit("x").alias("attribute"), F.col("o_orderdate").cast("timestamp").alias("observed_ts"), F.col("o_orderpriority").alias("resolver_id"), F.lit(None).cast("string").alias("attester_id"), F.col("o_orderpriority").alias("authority_family"), F.col("o_orderkey").alias("line_no"))
    first = o.groupBy("trap_id").agg(F.min("observed_ts").alias("scheduled_resolution_ts"))
    _, rejected = facts.build_traps(o.join(first, "trap_id"), F.lit("1996-01-01").cast("timestamp"))
    return rejected.select("trap_id", F.array_join("reasons", ",").alias("reasons"))


@bound("claim_changes", "WITH s AS (SELECT l_partkey, list_sort(list(DISTINCT l_returnflag) FILTER (l_linenumber <= 2)) AS a, list_sort(list(DISTINCT l_returnflag) FILTER (l_linenumber > 2)) AS b FROM lineitem GROUP BY 1) SELECT l_partkey, list_filter(b, lambda x: NOT list_contains(a, x))[1] AS added, list_filter(a, lambda x: NOT list_contains(b, x))[1] AS removed FROM s WHERE a IS NOT NULL AND b IS NOT NULL AND len(list_filter(b, lambda x: NOT list_contains(a, x))) = 1 AND len(list_filter(a, lambda x: NOT list_contains(b, x))) <= 1")
def q_claims(spark, d):
    li = read(spark, d, "lineitem").groupBy("l_partkey").agg(F.collect_set(F.when(F.col("l_linenumber") <= 2, F.col("l_returnflag"))).alias("a"), F.collect_set(F.when(F.col("l_linenumber") > 2, F.col("l_returnflag"))).alias("b"))
    return li.where("size(a) > 0 and size(b) > 0").select("l_partkey", facts.claim_changes(F.col("a"), F.col("b")).alias("c")).where("c is not null").select("l_partkey", "c.added", "c.removed")


# --- gates and records --------------------------------------------------------------------------------------
@bound("remaining_trials", "WITH c AS (SELECT o_custkey AS row_id, count(*) AS n FROM orders GROUP BY 1) SELECT c_custkey AS row_id, 12 - least(coalesce(n, 0), 12) AS remaining FROM customer LEFT JOIN c ON c_custkey = row_id WHERE 12 - least(coalesce(n, 0), 12) > 0")
def q_remaining(spark, d):
    done = records.completed_trials(read(spark, d, "orders").withColumnRenamed("o_custkey", "row_id"))
    return records.remaining_trials(read(spark, d, "customer").select(F.col("c_custkey").alias("row_id")), done, 12)


@bound("trial_audit", "WITH c AS (SELECT o_custkey AS row_id, count(*) AS n FROM orders GROUP BY 1) SELECT c_custkey AS row_id, coalesce(n, 0) AS done, CASE WHEN coalesce(n, 0) < 10 THEN 'missing' ELSE 'duplicate' END AS problem FROM customer LEFT JOIN c ON c_custkey = row_id WHERE coalesce(n, 0) != 10")
def q_audit(spark, d):
    done = records.completed_trials(read(spark, d, "orders").withColumnRenamed("o_custkey", "row_id"))
    return records.trial_audit(read(spark, d, "customer").select(F.col("c_custkey").alias("row_id")), done, 10)


@bound("error_gate", "SELECT count(*) FILTER (event_type = 'error') AS failed, count(*) AS total, count(*) FILTER (event_type = 'error') / count(*) AS rate, count(*) = 10000 AND count(*) FILTER (event_type = 'error') / count(*) <= 0.05 AS passed FROM events")
def q_gate(spark, d):
    return records.result_gate(read(spark, d, "events").select(F.when(F.col("event_type") == "error", "e").alias("error")), 10000, 0.05)


@bound("release_audit", "SELECT 'url in url' AS problem, count(*) AS n FROM pages UNION ALL SELECT 'repeated url', count(*) - count(DISTINCT url) FROM pages HAVING count(*) > count(DISTINCT url)")
def q_release(spark, d):
    p = read(spark, d, "pages").select("page_id", "url", F.lit("a").alias("arm"))
    return records.audit_release(p, "url", ["page_id"], [], ["arm"])


LAB = "j AS (SELECT d.doc_id, d.lang, d.source, l.quality AS judge, 1 - l.toxic AS gate, l.quality * (1 - l.toxic) AS gated FROM documents d JOIN labels l USING (doc_id))"


def judged(spark, d) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", "lang", "source").join(read(spark, d, "labels"), "doc_id").select("doc_id", "lang", "source", F.col("quality").alias("judge"), (1 - F.col("toxic")).alias("gate"), (F.col("quality") * (1 - F.col("toxic"))).alias("gated"))


@bound("disagreements", f"WITH {LAB} SELECT lang, count(*) FILTER (gate = 1 AND judge = 0) AS visible_but_wrong, count(*) FILTER (judge = 1 AND gated = 0) AS judge_right_match_wrong FROM j GROUP BY 1")
def q_disagree(spark, d):
    return records.disagreements(judged(spark, d), ["lang"], "gate", "judge", "gated")


@bound("failure_funnel", f"WITH {LAB} SELECT lang, count(*) AS n, count(*) FILTER (gate = 1) AS seen, count(*) FILTER (gate = 1 AND judge = 1) AS used FROM j GROUP BY 1")
def q_funnel(spark, d):
    return records.funnel(judged(spark, d).select("lang", (F.col("gate") == 1).alias("seen"), (F.col("judge") == 1).alias("used")), ["lang"], ["seen", "used"])


@bound("failed_by_all", f"WITH {LAB} SELECT source, count(DISTINCT lang) AS models FROM j GROUP BY 1 HAVING count(DISTINCT lang) = 4 AND max(1 - gate) = 0")
def q_failed(spark, d):
    return records.failed_by_all(judged(spark, d).withColumn("toxic", 1 - F.col("gate")), "source", "lang", "toxic", 4)


@bound("search_histogram", f"WITH {ROWS} SELECT condition, least(searches, 4) AS searches, count(*) AS n, avg(score) AS accuracy FROM e GROUP BY 1, 2")
def q_histogram(spark, d):
    return records.search_histogram(event_rows(spark, d), ["condition"], "searches", "score", 4)


@bound("cost_table", f"WITH {ROWS} SELECT condition, quantile_cont(cost, 0.5) AS median_cost, quantile_cont(cost, 0.95) AS p95_cost, max(cost) AS max_cost, sum(cost) / sum(searches) AS cost_per_correct FROM e GROUP BY 1")
def q_costs(spark, d):
    return records.cost_table(event_rows(spark, d), ["condition"], "cost", "searches")


@bound("router_simulation", f"WITH {ROWS}, r AS (SELECT task_key, avg(score) AS s, avg(cost) AS c FROM e WHERE condition = CASE WHEN task_key % 3 = 0 THEN 'purchase' ELSE 'click' END GROUP BY 1) SELECT count(*) AS tasks, avg(s) AS score, sum(c) AS cost FROM r")
def q_router(spark, d):
    return records.routed(event_rows(spark, d), "task_key", "condition", F.when(F.col("task_key") % 3 == 0, "purchase").otherwise("click"), "score", "cost")


@bound("repeat_variance", f"WITH {ROWS} SELECT task_key, count(*) AS trials, stddev_samp(score) AS deviation FROM e GROUP BY 1")
def q_variance(spark, d):
    return records.repeat_variance(event_rows(spark, d), "task_key", "score")


@bound("model_costs", "SELECT o_orderkey, ((t - least(c, t)) * 2.0::DOUBLE + least(c, t) * 2.0::DOUBLE * 0.1::DOUBLE + 10 * 12.0::DOUBLE) / 1000000 AS model_usd FROM (SELECT o_orderkey, o_orderkey % 1000 AS t, o_orderkey % 300 AS c FROM orders)")
def q_cost(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.lit("gpt-5.6-terra").alias("model"), (F.col("o_orderkey") % 1000).alias("prompt_tokens"), F.lit(10).alias("completion_tokens"), (F.col("o_orderkey") % 300).alias("cached_tokens"))
    prices = spark.createDataFrame([("gpt-5.6-terra", 2.0, 12.0)], "model string, input_usd double, output_usd double")
    return records.priced(o, prices).select("o_orderkey", "model_usd")


# --- models -------------------------------------------------------------------------------------------------
@bound("ols_slope", f"WITH {LAT} SELECT regr_intercept(q, latency) AS intercept, regr_slope(q, latency) AS slope, count(*) AS n FROM l")
def q_ols(spark, d):
    fit = models.ols(latencies(spark, d), "q", ["intercept", "latency"], "model")
    return spark.createDataFrame([(float(fit.beta[0]), float(fit.beta[1]), fit.n)], "intercept double, slope double, n bigint")


@bound("mixed_model")
def q_lmm(spark, d):
    fit = models.lmm(event_rows(spark, d), "score", ["intercept", "searches"], "task_key")
    return spark.createDataFrame(fit.table())


@bound("logistic_cluster_robust")
def q_logistic(spark, d):
    rows = event_rows(spark, d).withColumn("y", (F.col("score") > 50).cast("int"))
    return spark.createDataFrame(models.logistic(rows, "y", ["intercept", "searches"], "task_key").table())


@bound("gee_logit")
def q_gee(spark, d):
    rows = event_rows(spark, d).withColumn("y", (F.col("score") > 50).cast("int"))
    return spark.createDataFrame(models.gee_logit(rows, "y", ["intercept", "searches"], "task_key").table())
