"""Counts per key and bucket over a stream, with late rows up to a bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_counts(rows: DataFrame, key: str, ts: str, grain: str = "1 day", late: str = "2 days") -> DataFrame:
    """(key, bucket, y) of a streaming frame; append mode gives a bucket once the watermark has passed it."""
    timed = rows.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"))
    return timed.withWatermark("ts", late).groupBy("key", F.window("ts", grain)).agg(F.count("*").alias("y")).select("key", F.col("window.start").alias("bucket"), "y")
