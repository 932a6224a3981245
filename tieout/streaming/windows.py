"""Continuous forms of the batch operators: extensions over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total): counts of windows; rows later than the watermark are left out."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", F.col("total").cast("decimal(28,2)").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events with no longer gap between them."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_notices(notices: DataFrame, late: str = "1 day") -> DataFrame:
    """notices(task_id, cycle, event, ts, ...) with each (task, cycle, event) once."""
    return notices.withWatermark("ts", late).dropDuplicatesWithinWatermark(["task_id", "cycle", "event"])
