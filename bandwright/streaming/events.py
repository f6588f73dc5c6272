"""Event-time windows with watermarks: late events within the delay count, later ones don't."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, delay: str) -> DataFrame:
    """Times without a zone are taken in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def tumbling(events: DataFrame, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    w = _timed(events, delay).groupBy(F.window("ts", size).alias("w"), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sliding(events: DataFrame, size: str = "2 hours", step: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events and distinct users, counted exactly: per window and user, then per window."""
    per = _timed(events, delay).groupBy(F.window("ts", size, step).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("w").agg(F.sum("n").alias("n"), F.count("user_id").alias("users")).select(F.col("w.start").alias("start"), "n", "users")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    w = _timed(events, delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return w.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
