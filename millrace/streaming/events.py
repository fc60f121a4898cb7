"""Event streams: the same transformations for batch tables and Structured Streaming (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, time: str, every: str, by: str, value: str, late: str | None = None) -> DataFrame:
    """Counts and sums by window and key; with late, rows later than that are dropped by the watermark of a stream."""
    src = events.withWatermark(time, late) if late else events
    found = src.groupBy(F.window(time, every).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return found.select(F.col("w.start").alias("window_start"), by, "n", "total")


def sliding(events: DataFrame, time: str, length: str, every: str, value: str) -> DataFrame:
    found = events.groupBy(F.window(time, length, every).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return found.select(F.col("w.start").alias("window_start"), "n", "mean")


def sessions(events: DataFrame, time: str, gap: str, by: str, value: str) -> DataFrame:
    """Stretches of a key's events with no gap of that length."""
    found = events.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return found.select(by, F.col("w.start").alias("session_start"), "n", "total")


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
