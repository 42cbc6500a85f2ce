"""Captured responses of providers, put together from ``pages`` and ``lineitem``; the SQL works on the tables' rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import adapters
from .bindings import bound, read

col = F.col
joined = lambda c: F.array_join(c, "|")


def gathered(order: str, where: Column, *fields: Column) -> Column:
    """An array of structs of a key's rows, in order."""
    return F.transform(F.sort_array(F.collect_list(F.when(where, F.struct(order, F.struct(*fields).alias("s"))))), lambda x: x["s"])


def responses(spark: SparkSession, d: str) -> DataFrame:
    """Seven pages to a response, of which some are news; what a result says depends on its number."""
    p = read(spark, d, "pages").select("page_id", "url", (col("page_id") % 7).alias("k"))
    k, n = col("k"), col("page_id").cast("string")
    none = F.array().cast("array<string>")
    item = [
        col("url").alias("url"), F.concat(F.lit("Page "), n).alias("title"), F.concat(F.lit("D"), n).alias("description"),
        F.when(k % 3 > 0, F.array(F.concat(F.lit("S"), n), col("url"))).otherwise(none).alias("snippets"), F.when(k % 4 == 1, F.array(F.concat(F.lit("H"), n))).alias("highlights"), F.when(k % 5 > 0, F.concat(F.lit("2024-01-0"), k.cast("string"))).otherwise("").alias("page_age"),
    ]
    news = (col("page_id") * 31 % 5) < 2
    return p.groupBy(F.floor(col("page_id") / 7).alias("row_id")).agg(gathered("page_id", ~news, *item).alias("web"), gathered("page_id", news, *item).alias("news"))


_RANKED = """p AS (SELECT page_id // 7 AS row_id, page_id, url, page_id % 7 AS k, (page_id * 31 % 5) < 2 AS news FROM pages),
 s AS (SELECT *, row_number() OVER (PARTITION BY row_id, news ORDER BY page_id) AS section_rank,
   CASE WHEN k % 4 = 1 THEN 'H' || page_id WHEN k % 3 > 0 THEN 'S' || page_id || chr(10) || url ELSE 'D' || page_id END AS snippet, CASE WHEN k % 5 > 0 THEN '2024-01-0' || k ELSE '' END AS told FROM p),
 r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY section_rank, news) AS rank FROM s)"""


@bound("search_results", f"""WITH {_RANKED} SELECT row_id, string_agg(url, '|' ORDER BY rank) AS urls, string_agg(snippet, '|' ORDER BY rank) AS snippets, string_agg(CASE WHEN news THEN 'publication' ELSE 'page_age' END, '|' ORDER BY rank) AS semantics,
 string_agg('[' || rank || '] Page ' || page_id || chr(10) || url || CASE WHEN told != '' THEN chr(10) || told ELSE '' END || chr(10) || snippet, chr(10) || chr(10) ORDER BY rank) AS shown FROM r GROUP BY 1""")
def q_responses(spark, d):
    """V1, V2, W4, W5."""
    each = lambda c: joined(F.transform("results", lambda x: x[c]))
    r = adapters.sectioned_results(responses(spark, d))
    return r.select("row_id", each("url").alias("urls"), each("snippet").alias("snippets"), each("date_semantics").alias("semantics"), adapters.rendered(col("results")).alias("shown"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Line items with a place that none shares in its order; line numbers repeat."""
    place = col("l_linenumber") * 10**12 + col("l_partkey") * 10**6 + col("l_suppkey")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", place.alias("pos"))


def actions(spark: SparkSession, d: str) -> DataFrame:
    """An order's lines are actions of three kinds; those of many pieces are cited, some without a title."""
    li = lines(spark, d)
    link = lambda c: F.concat(F.lit("https://h/"), (col(c) % 9).cast("string"))
    kind = F.element_at(F.array(F.lit("search"), F.lit("open_page"), F.lit("find")), (col("l_partkey") % 3 + 1).cast("int"))
    title = F.when(col("l_suppkey") % 4 > 0, F.concat(F.lit("T"), col("l_suppkey").cast("string"))).otherwise("")
    act = [kind.alias("type"), F.concat(F.lit("q"), col("l_partkey").cast("string")).alias("query"), F.array(link("l_partkey"), link("l_suppkey")).alias("sources")]
    return li.groupBy(col("l_orderkey").alias("row_id")).agg(gathered("pos", F.lit(True), *act).alias("actions"), gathered("pos", col("l_quantity") > 10, link("l_partkey").alias("url"), title.alias("title")).alias("citations"))


@bound("action_searches", """WITH l AS (SELECT l_orderkey, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey AS pos, l_partkey % 3 AS kind, ['https://h/' || l_partkey % 9, 'https://h/' || l_suppkey % 9] AS sources, 'https://h/' || l_partkey % 9 AS url, l_quantity > 10 AS cited, CASE WHEN l_suppkey % 4 > 0 THEN 'T' || l_suppkey ELSE '' END AS title FROM lineitem),
 t AS (SELECT l_orderkey, url, arg_min(title, pos) AS title FROM l WHERE cited AND title != '' GROUP BY 1, 2),
 s AS (SELECT l_orderkey, pos, unnest([1, 2]) AS nth, unnest(sources) AS url FROM l WHERE kind = 0),
 x AS (SELECT l_orderkey, string_agg(coalesce(title, ''), '|' ORDER BY pos, nth) AS titles FROM s LEFT JOIN t USING (l_orderkey, url) GROUP BY 1)
 SELECT l_orderkey AS row_id, count(*) FILTER (kind = 0)::INTEGER AS searches, count(*) FILTER (kind = 1)::INTEGER AS opened, count(*) FILTER (kind = 2)::INTEGER AS found, coalesce(any_value(titles), '') AS titles FROM l LEFT JOIN x USING (l_orderkey) GROUP BY 1""")
def q_actions(spark, d):
    """V4, J17."""
    titles = F.flatten(F.transform("trajectory", lambda s: F.transform(s["results"], lambda r: r["title"])))
    return adapters.action_searches(actions(spark, d)).select("row_id", "searches", "opened", "found", joined(titles).alias("titles"))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """A line asks; lines of more than ten pieces are answered, every third with an error, in an order of their own."""
    li = lines(spark, d)
    n, name = col("l_linenumber"), F.concat(F.lit("i"), col("pos").cast("string"))
    null = F.lit(None).cast("string")
    ask = F.struct(F.lit("server_tool_use").alias("type"), name.alias("id"), null.alias("tool_use_id"), F.concat(F.lit("q"), col("l_partkey").cast("string")).alias("query"), null.alias("error"), F.lit(None).cast("array<string>").alias("results"))
    tell = F.struct(F.lit("web_search_tool_result").alias("type"), null.alias("id"), name.alias("tool_use_id"), null.alias("query"), F.when(col("l_partkey") % 3 == 0, "max_uses").alias("error"), F.array_repeat(F.lit("r"), n.cast("int")).alias("results"))
    said = F.array_compact(F.array(F.struct((n * 10).alias("at"), ask.alias("b")), F.when(col("l_quantity") > 10, F.struct((n * 7 % 5 * 10 + 5).alias("at"), tell.alias("b")))))
    return li.groupBy(col("l_orderkey").alias("row_id")).agg(F.transform(F.sort_array(F.flatten(F.collect_list(said))), lambda x: x["b"]).alias("blocks"))


@bound("block_searches", "SELECT l_orderkey AS row_id, 'q' || l_partkey AS query, CASE WHEN l_quantity > 10 AND l_partkey % 3 = 0 THEN 'max_uses' END AS error, CASE WHEN l_quantity > 10 AND l_partkey % 3 != 0 THEN l_linenumber END::INTEGER AS n FROM lineitem")
def q_blocks(spark, d):
    """V3, J16."""
    return adapters.block_searches(blocks(spark, d)).select("row_id", "query", "error", F.when(col("results").isNotNull(), F.size("results")).alias("n"))
