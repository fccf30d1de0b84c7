"""Windowed counts of an event stream, with watermarks for late rows.

The same transformation serves batch and stream: `read` decides. As a stream its
state is bounded by the watermark: a window is dropped once it can't change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATE = "10 minutes"


def read(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """A folder (or file) of Parquet events, whole or file by file as they arrive."""
    if not stream:
        return spark.read.parquet(path)
    rows = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 8).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need instants


def per_window(events: DataFrame, size: str = "1 hour") -> DataFrame:
    """start, event_type, n, total for each tumbling window and type."""
    counted = events.withWatermark("ts", LATE).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def per_session(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, start and n of each run of a user's events with less than gap between them."""
    counted = events.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("w.start").alias("start"), "n")


def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_window(read(spark, f"{sf_dir}/events.parquet"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_session(read(spark, f"{sf_dir}/events.parquet"))
