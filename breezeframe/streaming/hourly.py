"""Incremental views of the event feed with Structured Streaming.

Late rows are dropped by the watermark here; the batch operators refuse unordered input instead.
A stream that ends keeps to itself the windows that end after its last watermark; `drained`
adds them from a batch pass over the events that can be in them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.adapters import shared_folder


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream; watermarks need a timestamp with a zone."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")


def hourly_windows(events: DataFrame) -> DataFrame:
    return events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Spells of one user's events with no gap longer than `gap`."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def drained(spark: SparkSession, sf_dir: str, windows: Callable[[DataFrame], DataFrame], still_open: Callable[[DataFrame, Column], DataFrame]) -> DataFrame:
    """All windows of the events: those a stream over all that is there emits, and those it still holds.

    `still_open` gives the events that windows ending after a watermark are made of. Nothing
    is collected: the stream writes to files in the shared folder.
    """
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    stream = windows(event_stream(spark, sf_dir))
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    last = query.lastProgress
    reached = ((last and last["eventTime"]) or {}).get("watermark", "1970-01-01T00:00:00.000Z")
    watermark = F.lit(reached).cast("timestamp")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    held = windows(still_open(events, watermark)).where(F.col("w.end") > watermark)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows").unionByName(held)


def in_open_hours(events: DataFrame, watermark: Column) -> DataFrame:
    return events.where(F.col("ts") >= watermark - F.make_dt_interval(hours=F.lit(1)))


def of_open_sessions(events: DataFrame, watermark: Column) -> DataFrame:
    """All events of the users that have one within the gap before the watermark, or later: sessions can begin at any time."""
    users = events.where(F.col("ts") > watermark - F.make_dt_interval(hours=F.lit(6))).select("user_id").distinct()
    return events.join(users, "user_id", "left_semi")
