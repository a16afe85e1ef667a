"""Event-time windows, of batches and of streams; decision files are watched in ``chain``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 day", late: str | None = "1 hour") -> DataFrame:
    """Counts and sums by event type and window; a batch or, with a watermark, a stream."""
    source = events.withWatermark("ts", late) if late and events.isStreaming else events
    return source.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str | None = "1 hour") -> DataFrame:
    source = events.withWatermark("ts", late) if late and events.isStreaming else events
    return source.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("finish"), "user_id", "n")
