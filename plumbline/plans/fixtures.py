"""Run flags, facts, run plans and documents whose inputs follow from a table's keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import adapters, readers
from . import control
from .bindings import bound, read

day = lambda c: F.date_format(c, "yyyy-MM-dd")
OFFICIAL = {"sec.gov": "sec"}

# V5, V6, V7, F57
_RUNS = "SELECT o_orderkey, used = 0 AS zero_search_row, errors > 0 AS search_degraded, used > 0 AND errors >= used AS search_fully_failed, round(used * 0.005 + t / 1000.0, 6)::DOUBLE AS total_cost_usd, CASE WHEN t > 0 THEN round(c / t::DOUBLE, 6) END::DOUBLE AS cache_hit_rate FROM (SELECT o_orderkey, o_orderkey % 4 AS used, o_orderkey % 3 AS errors, o_orderkey % 11 AS t, o_orderkey % 5 AS c FROM orders)"


@bound("run_flags", _RUNS)
def q_run_flags(spark, d):
    k = F.col("o_orderkey")
    rows = read(spark, d, "orders").select("o_orderkey", F.lit("harness").alias("mode"), (k % 4).alias("used_searches"), (k % 3).alias("search_errors"), (k % 4 * 0.005).alias("search_usd"), (k % 11 / 1000.0).alias("model_usd"), (k % 11).alias("prompt_tokens"), (k % 5).alias("cached_tokens"))
    return adapters.run_flags(rows).select("o_orderkey", "zero_search_row", "search_degraded", "search_fully_failed", F.round("total_cost_usd", 6).alias("total_cost_usd"), F.round("cache_hit_rate", 6).alias("cache_hit_rate"))


# C14 to C16
@bound("emitted_facts", "SELECT s_suppkey, 'ceo_of' AS attribute, s_name AS new_value, CASE WHEN s_suppkey % 2 = 0 THEN 'sec' ELSE 'publisher:news.example.org' END AS authority_family, 'filing' AS source_type, 'r1' AS resolver_id, TRUE AS distribution_rights_confirmed FROM supplier")
def q_emitted(spark, d):
    url = F.when(F.col("s_suppkey") % 2 == 0, "https://www.sec.gov/a").otherwise("https://news.example.org/b")
    out = adapters.emitted(read(spark, d, "supplier"), F.col("s_name"), adapters.family_of(url, OFFICIAL), "filing", "r1", s_suppkey=F.col("s_suppkey"), attribute=F.lit("ceo_of"), new_value=F.col("s_name"))
    return out.drop("attester_id")


# Plans of runs for each nation's number of models
def _plan_rows() -> list[tuple]:
    out = []
    for n in range(5):
        models = [(f"v{k}", f"m{k}") for k in range(n + 1)]
        cells = control.matrix(models, ["normalized", "wide"], {"v0"})
        order = control.seeded_order(cells, "seed")
        first = control.next_condition(order, [c for c in cells if c.vendor == "v0"][:1])
        same = control.fingerprint(cells, {"a": 1, "max_concurrency": 4}) == control.fingerprint(cells, {"a": 1, "max_concurrency": 8})
        wrong = control.approval({"artifact_sha256": "a", "policy_sha256": "p", "approved_on": "2026-01-01", "rights_confirmed": True, "privacy_confirmed": n > 0, "scope_confirmed": True}, "a", "p", "2026-02-01")
        out.append((n, len(cells), sorted(c.label for c in cells) == sorted(c.label for c in order) and order == control.seeded_order(cells[::-1], "seed"), control.search_ceiling(cells, 10, 5, 2), first is None or first.vendor != "v0", same, ",".join(wrong)))
    return out


@bound("run_plans", "SELECT n_nationkey, n::INTEGER AS n, (3 * (n + 1) + 1)::INTEGER AS conditions, TRUE AS seeded, round((2 * (n + 1) * 0.005 + 0.01) * 100, 6)::DOUBLE AS ceiling_usd, TRUE AS other_vendor, TRUE AS same_plan, CASE WHEN n = 0 THEN 'privacy_confirmed not confirmed' ELSE '' END AS missing FROM (SELECT n_nationkey, n_nationkey % 5 AS n FROM nation)")
def q_plans(spark, d):
    plans = spark.createDataFrame(_plan_rows(), "n int, conditions int, seeded boolean, ceiling_usd double, other_vendor boolean, same_plan boolean, missing string")
    return read(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") % 5).alias("n")).join(F.broadcast(plans), "n").withColumn("ceiling_usd", F.round("ceiling_usd", 6))


# S22, S23
@bound("ownership_documents", "SELECT s_suppkey, '3' AS form_type, lpad(s_suppkey::VARCHAR, 10, '0') AS issuer_cik, s_name AS issuer_name, lpad((s_suppkey + 7)::VARCHAR, 10, '0') AS owner_cik, '2026-07-06' AS period, s_suppkey % 2 = 0 AS is_officer, s_suppkey % 3 = 0 AS is_director, CASE WHEN s_suppkey % 2 = 0 THEN 'CEO' END AS officer_title FROM supplier")
def q_ownership(spark, d):
    k = F.col("s_suppkey")
    xml = F.concat(F.lit("<ownershipDocument><documentType>3</documentType><periodOfReport><value>2026-07-06-05:00</value></periodOfReport><issuer><issuerCik>"), k.cast("string"), F.lit("</issuerCik><issuerName>"), "s_name", F.lit("</issuerName></issuer><reportingOwner><reportingOwnerId><rptOwnerCik>"), (k + 7).cast("string"), F.lit("</rptOwnerCik><rptOwnerName>N</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isOfficer>"), F.when(k % 2 == 0, "1").otherwise("0"), F.lit("</isOfficer><isDirector>"), F.when(k % 3 == 0, "true").otherwise("false"), F.lit("</isDirector>"), F.when(k % 2 == 0, "<officerTitle><value> CEO </value></officerTitle>").otherwise("<officerTitle> </officerTitle>"), F.lit("</reportingOwnerRelationship></reportingOwner></ownershipDocument>"))
    out = readers.ownership(read(spark, d, "supplier").select("s_suppkey", xml.alias("xml")))
    return out.select("s_suppkey", "form_type", "issuer_cik", "issuer_name", "owner_cik", day("period_of_report").alias("period"), "is_officer", "is_director", "officer_title")
