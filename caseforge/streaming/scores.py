"""Re-scoring of arriving events: windowed rates with a watermark, and running series statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_rates(events: DataFrame, ts: str = "ts", kind: str = "event_type", value: str = "value", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count, mean and largest value per window and kind; rows later than ``late`` are dropped by the watermark. Batch frames work as well."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark(ts, late)
    g = e.groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("highest"))
    return g.select(F.col("window.start").alias("start"), kind, "n", "mean", "highest")


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a key that end after ``gap`` without a row."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark(ts, late)
    s = e.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return s.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
