"""Roots that are let through once all their required scores are there (X11).

Score spans arrive in any order and over any number of batches.  The state of a root is its score names with their last values by
order, kept by Spark's state store; when the last required score arrives, and whenever a score of a complete root changes
later, the root goes on with all its scores.  The sink is a table in versions with the root as key: a batch that is
replayed puts the same rows in the same places, and incomplete roots never get there.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources import versions

KEY = ["root_span_id"]
OUT = "root_span_id string, names array<string>, scores array<double>"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Completing(StatefulProcessor):
    """Per root: the last value of every score in one value of state, read and written once a batch; rows once the required ones are
    all there."""

    def __init__(self, required: list[str]):
        self.required = set(required)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("scores", "names array<string>, ats array<bigint>, scores array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.held.get() if self.held.exists() else None
        held = {n: (at, score) for n, at, score in zip(*before, strict=True)} if before else {}
        changed = False
        for row in rows:
            if row.name not in held or held[row.name][0] < row.at:
                held[row.name] = (row.at, row.score)
                changed = True
        if changed:
            names = sorted(held)
            scores = [held[n][1] for n in names]
            self.held.update((names, [held[n][0] for n in names], scores))
            if self.required <= held.keys():
                yield Row(root_span_id=key[0], names=names, scores=scores)

    def close(self) -> None:
        pass


def complete_roots(spans: DataFrame, required: list[str]) -> DataFrame:
    """A stream of (root_span_id string, name, score double, at bigint) as a stream of complete roots."""
    keyed = spans.select(F.col("root_span_id").cast("string").alias("root_span_id"), "name", F.col("score").cast("double").alias("score"), F.col("at").cast("bigint").alias("at"))
    return keyed.groupBy(*KEY).transformWithState(Completing(required), OUT, "Update", "None")


def into_table(roots: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that is there now into a table in versions, by root; what was read before is not read again."""

    def write(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            versions.upsert(batch, path, KEY)

    spark = roots.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return roots.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
