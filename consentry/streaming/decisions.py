"""Structured Streaming forms: the same column functions over unbounded events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import decide


def decide_stream(events: DataFrame, docs: DataFrame, statements: DataFrame, prefs: DataFrame | None, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Decides each micro-batch with the batch plan; sink gets the decisions and the batch number, and may be called again for a repeated batch."""

    def step(batch: DataFrame, number: int) -> None:
        sink(decide.decide(batch, docs, statements, prefs), number)

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(events: DataFrame, key: str, ts: str = "ts", within: str = "1 hour") -> DataFrame:
    """The first event of each cache key, which later ones within the time to live share."""
    return events.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def usage(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and mean value by window and event type, late data accepted for a while (an extension)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))


def uncertain_only(scored: DataFrame, uncertainty: str = "uncertainty", threshold: float = 0.25) -> DataFrame:
    """Rows to learn from: those whose evidential uncertainty (features.evidential) is at the threshold or above."""
    return scored.where(F.col(uncertainty) >= threshold)


def learn_in_batches(events: DataFrame, buffer: str, retrain: Callable[[DataFrame, int], None], every: int, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch to a buffer table and calls retrain whenever another ``every`` rows have come in.

    A repeated batch overwrites its own part of the buffer, so rows count once.
    """
    spark = events.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{buffer}/batch={number}")
        all_ = spark.read.parquet(buffer)
        counts = all_.agg(F.count("*").alias("n"), F.count_if(F.col("batch") < number).alias("before")).first()
        if counts["n"] // every > counts["before"] // every:
            retrain(all_, counts["n"] // every)

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
