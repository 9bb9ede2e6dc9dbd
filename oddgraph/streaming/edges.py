"""An extension of ours: event streams as temporal edges of a user and event-type graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A file source over a folder of Parquet files with the events' schema."""
    return spark.readStream.schema(SCHEMA).parquet(path)


def windowed_edges(events: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Edges (user, type) per tumbling window, weighted by events; later rows than the watermark are dropped by its definition."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width), "user_id", "event_type").agg(F.count("*").alias("w"), F.sum("value").alias("value")).select(
        F.col("window.start").alias("start"), F.col("user_id").alias("src"), F.col("event_type").alias("dst"), "w", "value"
    )


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """User sessions by gaps."""
    return events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(
        F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n"
    )
