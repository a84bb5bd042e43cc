"""Event counts as a stream: windows with a watermark, and running counts by year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    return spark.readStream.schema(like.schema).parquet(folder)


def windowed(events: DataFrame, ts: str = "ts", kind: str = "event_type", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """window_start, kind, n: rows later than the watermark are left out."""
    timed = events.withColumn("t_", F.col(ts).cast("timestamp")).withWatermark("t_", late)
    return timed.groupBy(F.window("t_", window), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), kind, "n")


def by_year(events: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    return events.groupBy(key, F.year(ts).alias("year")).agg(F.count(F.lit(1)).alias("n"))
