"""Streaming ingestion of observations, an extension: windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def windowed(events: DataFrame, width: str = "6 hours", late: str = "1 day") -> DataFrame:
    """(user_id, window, ob): whether a user's window has an error; rows later than the watermark are left out."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stamped.groupBy("user_id", F.window("ts", width)).agg(F.max((F.col("event_type") == "error").cast("long")).alias("ob"))
