"""Resumable ingest of export records as a stream: ours, beyond parity with the batch tools.

Records arrive as JSON lines in a folder; a root that comes again within the watermark is dropped, and each batch
is merged by (condition, root_span_id) into a table in versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.paired import keep_last
from ..sources import versions

KEY = ["condition", "root_span_id"]


def records_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(folder)


def deduplicated(records: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    return records.withWatermark(time, delay).dropDuplicatesWithinWatermark(KEY)


def windowed_scores(records: DataFrame, time: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Means by condition and tumbling window, late records up to ``delay`` counted."""
    w = records.withWatermark(time, delay).groupBy(F.window(time, width), "condition").agg(F.count("*").alias("n"), F.avg("score").alias("score"))
    return w.select(F.col("window.start").alias("start"), "condition", "n", "score")


def upsert_stream(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Into a table in versions with the key (condition, root_span_id); a batch is one commit, so a replay changes nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            versions.upsert(keep_last(batch.withColumn("__at", F.lit(epoch)), KEY, "__at").select(*batch.columns), path, KEY)

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
