"""Windowed aggregates of an event stream. The same plans run on batches and, with a watermark, on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _totals(grouped) -> DataFrame:
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def late(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Streams need a timestamp with zone and a watermark; batches pass unchanged."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay) if events.isStreaming else events


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    out = _totals(late(events).groupBy(F.window("ts", width).alias("w"), "event_type"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes") -> DataFrame:
    out = _totals(late(events).groupBy(F.window("ts", width, step).alias("w"), "event_type"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "2 hours") -> DataFrame:
    out = _totals(late(events).groupBy(F.session_window("ts", gap).alias("w"), "user_id"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "total")
