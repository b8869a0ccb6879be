"""Streaming forms of flow queries (an extension: the batch queries are the reference's)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files, with event time as a timestamp."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    x = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return x.withColumn("at", F.col("ts").cast("timestamp"))


def class_windows(events: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Events and their value per class and time window, events later than ``late`` being dropped."""
    w = F.window("at", width)
    x = events.withWatermark("at", late) if events.isStreaming else events
    out = x.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("packets"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("event_type").alias("class"), "packets", "total")


def flow_sessions(events: DataFrame, gap: str = "12 hours", late: str = "2 hours") -> DataFrame:
    """Sessions of a user: runs of events without a longer pause than ``gap``."""
    x = events.withWatermark("at", late) if events.isStreaming else events
    out = x.groupBy(F.session_window("at", gap).alias("s"), "user_id").agg(F.count("*").alias("packets"))
    return out.select("user_id", F.col("s.start").cast("timestamp_ntz").alias("start"), "packets")


def run_once(stream: DataFrame, path: str) -> DataFrame:
    """All that is there now, through the streaming engine, in append mode: a window or session is written once, when the
    watermark has passed its end, and its state is dropped; those still open at the end are not written."""
    q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")
