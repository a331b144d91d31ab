"""Event streams: stage times, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stage_times(events: DataFrame) -> DataFrame:
    """``(stage, started, finished)`` from ``(stage, status, ts)``: first running, then first done not before it."""
    started = events.where("status = 'running'").groupBy("stage").agg(F.min("ts").alias("started"))
    both = events.where("status = 'done'").join(started, "stage").where("ts >= started")
    finished = both.groupBy("stage").agg(F.min("ts").alias("finished"))
    return started.join(finished, "stage", "left")


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; works on batches and, with a watermark, on streams."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp"))
    if stamped.isStreaming:
        stamped = stamped.withWatermark("at", late)
    g = stamped.groupBy(F.window("at", length), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
    return g.select(F.col("window.start").alias("window_start"), "event_type", "n", F.col("total").cast("double").alias("total"))
