"""Tumbling windows, the same for batch and Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str, watermark: str | None = None) -> DataFrame:
    """``(event_type, window_start, n, total)`` of each window; late events go once a watermark has passed them."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if watermark:
        events = events.withWatermark("ts", watermark)
    sums = events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return sums.select("event_type", F.col("window.start").alias("window_start"), "n", "total")


def stream(spark: SparkSession, path: str, schema, width: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """The same over a folder of Parquet files that arrive one by one."""
    return tumbling(spark.readStream.schema(schema).parquet(path), width, watermark)
