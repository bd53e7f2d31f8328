"""Structured Streaming forms: hourly rate limits and contact sessions, with watermarks for late events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATE = "2 hours"


def hourly_counts(events: DataFrame, limit: int = 20) -> DataFrame:
    """Events per user and hour, and whether the allowance of that hour is used up. Works on a stream or a batch."""
    counted = events.withWatermark("ts", LATE).groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("w.start").alias("hour"), "n", (F.col("n") > limit).alias("limited"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Runs of a user's events with gaps up to ``gap``. Works on a stream or a batch."""
    grouped = events.withWatermark("ts", LATE).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("value").alias("peak"))
    return grouped.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n", "peak")
