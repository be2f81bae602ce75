"""Event-time helpers beyond what chat ingestion needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n) of activity sessions; works on streams, where rows later than ``late`` are dropped."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("_at", late)
    grouped = timed.groupBy(F.session_window("_at", gap).alias("w"), F.col(key)).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
