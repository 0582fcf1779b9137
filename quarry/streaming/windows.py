"""Counts and sums by window of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, key: str, value: str, width: str, late: str) -> DataFrame:
    """start, key, n, total and top of each window; on a stream, rows later than `late` behind the newest are dropped.

    Works alike on a table and on a stream. Times without a zone are taken as UTC, which watermarks need.
    """
    rows = events.withColumn("__at", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("__at", late) if rows.isStreaming else rows
    found = rows.groupBy(F.window("__at", width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("top"))
    return found.select(F.col("w.start").alias("start"), key, "n", "total", "top")
