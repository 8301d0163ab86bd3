"""Sessions of activity: runs of events with no longer gap between them than a given one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP_SECONDS = 1800
#: Events of a key are cut by slices of time first, so that one key is many tasks.
SLICE_SECONDS = 86_400


def activity_sessions(
    events: DataFrame, key: str = "job_id", time: str = "ts", gap_seconds: int = GAP_SECONDS, slice_seconds: int = SLICE_SECONDS
) -> DataFrame:
    """``(key, first, last, events)``: an event belongs to a session if it is at most ``gap_seconds`` after the one
    before it. Events without a time are in none.

    Sessions are made within slices of time, which cut a key of any size, and those that touch across a
    border are joined afterwards, on one row per session and slice.
    """
    dated = events.where(F.col(time).isNotNull()).select(F.col(key).alias("_key"), F.col(time).alias("_at"))
    slice_ = F.floor(F.unix_seconds("_at") / slice_seconds)
    window = F.session_window("_at", f"{gap_seconds} seconds")
    parts = dated.groupBy("_key", slice_.alias("_slice"), window).agg(F.min("_at").alias("first"), F.max("_at").alias("last"), F.count("*").alias("events"))
    in_order = Window.partitionBy("_key").orderBy("first")
    gap = F.unix_micros("first") - F.unix_micros(F.lag("last").over(in_order))
    marked = parts.withColumn("_new", F.coalesce((gap > gap_seconds * 1_000_000).cast("int"), F.lit(1)))
    marked = marked.withColumn("_session", F.sum("_new").over(in_order))
    whole = marked.groupBy("_key", "_session").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("events").alias("events"))
    return whole.select(F.col("_key").alias(key), "first", "last", "events")


def activity_sessions_stream(
    events: DataFrame, key: str = "job_id", time: str = "ts", gap_seconds: int = GAP_SECONDS, delay: str = "10 minutes"
) -> DataFrame:
    """The same of a stream in append mode: a session comes out once the greatest time so far, less ``delay``,
    is past its end; its state is dropped then. Later events of it are late, see :mod:`repolens.streaming.late`."""
    dated = events.select(F.col(key).alias("_key"), F.col(time).alias("_at")).withWatermark("_at", delay)
    window = F.session_window("_at", f"{gap_seconds} seconds")
    whole = dated.groupBy("_key", window).agg(F.min("_at").alias("first"), F.max("_at").alias("last"), F.count("*").alias("events"))
    return whole.select(F.col("_key").alias(key), "first", "last", "events")
