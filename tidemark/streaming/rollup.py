"""The rollup over a stream: event-time buckets with a watermark for late points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_rollup(points: DataFrame, bucket: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """points(ts timestamp, series, value), streaming or not -> (series, bucket, avg_value, points)."""
    grouped = points.withWatermark("ts", late).groupBy("series", F.window("ts", bucket).alias("w"))
    return grouped.agg(F.avg("value").alias("avg_value"), F.count("*").alias("points")).select("series", F.col("w.start").alias("bucket"), "avg_value", "points")
