"""Streams over the driver's tables, run until all that is there has been read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import versions
from ..sources.workdir import workdir
from ..streaming import complete
from .bindings import bound, read

col = F.col
REQUIRED = ["click", "purchase", "view"]


@bound("completed_roots", """WITH s AS (SELECT user_id::VARCHAR || '-' || json_extract(props, '$.k')::INT % 7 AS root, event_type AS name, arg_max(value, event_id) AS score FROM events WHERE event_id % 3 != 1 GROUP BY 1, 2)
 SELECT root AS root_span_id, string_agg(name, '|' ORDER BY name) AS names, round(sum(score), 6) AS total FROM s GROUP BY 1 HAVING count(*) FILTER (name IN ('click', 'purchase', 'view')) = 3""")
def q_completed(spark, d):
    """X11: ``events`` as score spans of roots, of which some lack a required one; they arrive in two parts, and the third run finds
    nothing new."""
    table, mark, folder = workdir(spark), workdir(spark), workdir(spark)
    root = F.concat_ws("-", "user_id", F.get_json_object("props", "$.k").cast("int") % 7)
    spans = read(spark, d, "events").where("event_id % 3 != 1").select(root.alias("root_span_id"), col("event_type").alias("name"), col("value").alias("score"), col("event_id").alias("at"))
    for part in ("at % 2 = 1", "at % 2 = 0", None):
        if part:
            spans.where(part).write.mode("append").parquet(folder)
        arriving = spark.readStream.schema(spans.schema).parquet(folder)
        complete.into_table(complete.complete_roots(arriving, REQUIRED), table, mark).awaitTermination()
    return versions.read(spark, table).select("root_span_id", F.array_join("names", "|").alias("names"), F.round(F.aggregate("scores", F.lit(0.0), lambda a, s: a + s), 6).alias("total"))
