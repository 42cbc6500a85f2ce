"""Captured provider responses to trajectory structs; only shapes, no calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def sectioned_results(responses: DataFrame) -> DataFrame:
    """From (row_id, web, news: arrays of structs url, title, description, snippets, highlights, page_age): one ranked list.

    Sections take turns, the longer tail follows; text is the highlights, else the snippets, else the
    description; news dates are publications, web dates are not (V1, W4, W5).
    """
    def section(name: str, priority: int) -> Column:
        return F.transform(F.coalesce(name, F.array().cast(responses.schema[name].dataType)), lambda r, i: F.struct(
            (i + 1).alias("section_rank"), F.lit(priority).alias("priority"), F.lit(name).alias("source"), r["url"].alias("url"), r["title"].alias("title"),
            F.coalesce(F.nullif(F.array_join(r["highlights"], "\n"), F.lit("")), F.nullif(F.array_join(r["snippets"], "\n"), F.lit("")), r["description"], F.lit("")).alias("snippet"),
            r["page_age"].alias("published_date"), F.lit("publication" if name == "news" else "page_age").alias("date_semantics")))

    merged = F.array_sort(F.concat(section("web", 0), section("news", 1)))
    ranked = F.transform(merged, lambda r, i: F.struct((i + 1).alias("rank"), *[r[c].alias(c) for c in ("section_rank", "source", "url", "title", "snippet", "published_date", "date_semantics")]))
    return responses.select("row_id", ranked.alias("results"))


def rendered(results: Column) -> Column:
    """The text that a model is shown of ranked results (V2)."""
    return F.array_join(F.transform(results, lambda r: F.concat_ws("\n", F.concat(F.lit("["), r["rank"].cast("string"), F.lit("] "), F.coalesce(r["title"], F.lit(""))), r["url"], F.nullif(r["published_date"], F.lit("")), F.nullif(r["snippet"], F.lit("")))), "\n\n")


def block_searches(responses: DataFrame) -> DataFrame:
    """From (row_id, blocks array<struct<type,id,tool_use_id,query,error,results>>): queries with their results.

    A result block that carries an error gives no results but its code.
    """
    each = responses.select("row_id", F.posexplode("blocks").alias("pos", "b"))
    asked = each.where("b.type = 'server_tool_use'").select("row_id", "pos", F.col("b.id").alias("id"), F.col("b.query").alias("query"))
    told = each.where("b.type = 'web_search_tool_result'").select("row_id", F.col("b.tool_use_id").alias("id"), F.col("b.error").alias("error"), F.when(F.col("b.error").isNull(), F.col("b.results")).alias("results"))
    return asked.join(told, ["row_id", "id"], "left").select("row_id", "pos", "query", "error", "results")


def action_searches(responses: DataFrame) -> DataFrame:
    """From (row_id, actions array<struct<type,query,sources array<string>>>, citations array<struct<url,title>>): search
    actions, titles filled in from citations; counts of all kinds of actions (V4, J17)."""
    titles = F.map_from_entries(F.transform(F.array_distinct(F.transform("citations", lambda c: c["url"])), lambda u: F.struct(u.alias("key"), F.get(F.filter("citations", lambda c: (c["url"] == u) & (F.coalesce(c["title"], F.lit("")) != "")), F.lit(0))["title"].alias("value"))))
    steps = F.transform(F.filter("actions", lambda a: a["type"] == "search"), lambda a: F.struct(F.lit("search").alias("type"), a["query"].alias("query"), F.transform(a["sources"], lambda u, i: F.struct(F.lit(None).cast("int").alias("rank"), (i + 1).alias("provider_order"), u.alias("url"), F.coalesce(F.col("__titles")[u], F.lit("")).alias("title"))).alias("results")))
    counted = lambda kind: F.size(F.filter("actions", lambda a: a["type"] == kind))
    return responses.withColumn("__titles", titles).select("row_id", steps.alias("trajectory"), counted("search").alias("searches"), counted("open_page").alias("opened"), counted("find").alias("found"))


def run_flags(rows: DataFrame) -> DataFrame:
    """Zero-search, degraded and failed flags, total cost and cache hit rate of a run's rows.

    Needs mode, used_searches, search_errors, search_usd, model_usd, prompt_tokens, cached_tokens.
    """
    treated = F.col("mode") != "none"
    return rows.select(
        "*",
        (treated & (F.coalesce("used_searches", F.lit(0)) == 0)).alias("zero_search_row"),
        (F.coalesce("search_errors", F.lit(0)) > 0).alias("search_degraded"),
        (treated & (F.coalesce("used_searches", F.lit(0)) > 0) & (F.coalesce("search_errors", F.lit(0)) >= F.col("used_searches"))).alias("search_fully_failed"),
        (F.col("search_usd") + F.col("model_usd")).alias("total_cost_usd"),
        F.try_divide(F.col("cached_tokens"), F.col("prompt_tokens")).alias("cache_hit_rate"),
    )


def error_code(status: Column, name: Column) -> Column:
    """F52."""
    return F.coalesce(status.cast("string"), name)


def as_of(explicit: Column, row_id: Column, snapshot: str) -> Column:
    """Explicit date, else a date within the id, else the snapshot's."""
    return F.coalesce(F.nullif(explicit, F.lit("")), F.nullif(F.regexp_extract(row_id, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), F.lit(snapshot))


def dated_question(question: Column, day: Column) -> Column:
    """F29."""
    return F.concat(F.rtrim(question), F.lit(" (as of "), day, F.lit(")"))


def experiment_label(kind: Column) -> Column:
    """Row-relative search range."""
    return F.when(kind.isin("day", "week"), F.concat(F.lit("row_"), kind)).otherwise(kind)


def reference_urls(references: Column) -> Column:
    """P854 URLs of a claim's references, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(references, lambda r: F.coalesce(r["P854"], F.array().cast("array<string>")))), lambda u: u.isNotNull())))


def claim_value(claim: Column) -> Column:
    """id, amount or time of a claim's JSON."""
    at = lambda p: F.get_json_object(claim, f"$.mainsnak.datavalue.value.{p}")
    return F.coalesce(at("id"), at("amount"), at("time"))


def claim_ids(values: Column) -> Column:
    """F43."""
    return F.filter(values, lambda v: F.startswith(v, F.lit("Q")) | F.startswith(v, F.lit("P")))


def emitted(rows: DataFrame, attester: Column, family: Column, source_type: str, resolver: str, **columns: Column) -> DataFrame:
    """Fact events by projection."""
    return rows.select(*[c.alias(n) for n, c in columns.items()], attester.alias("attester_id"), family.alias("authority_family"), F.lit(source_type).alias("source_type"), F.lit(resolver).alias("resolver_id"), F.lit(True).alias("distribution_rights_confirmed"))


def family_of(url: Column, official: dict[str, str]) -> Column:
    return T.authority_family(url, official)
