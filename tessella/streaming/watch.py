"""Streams of file events: filtering, debounce, expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: File operations that change nothing in a file.
IGNORED = ["chmod"]


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of event files (Parquet) below a folder; new files and folders are found by the source."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 64).parquet(path)


def wanted(events: DataFrame, ignored: list[str] = IGNORED, op: str = "event_type") -> DataFrame:
    return events.where(~F.coalesce(F.col(op).isin(ignored), F.lit(False)))


def debounce(events: DataFrame, silence: str = "5 seconds", late: str | None = "1 minute", keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """(keys, start, last, events): one row for each burst of events, ended by a silence.

    Batch or stream; a stream emits a burst once the watermark has passed its end. Time zone-less times are taken as UTC.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming and late:
        timed = timed.withWatermark("ts", late)
    bursts = timed.groupBy(F.session_window("ts", silence).alias("w"), *keys).agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last"))
    return bursts.select(*keys, F.col("w.start").alias("start"), "last", "events")


def live(entries: DataFrame, now: str, ttl_seconds: int, ts: str = "ts") -> DataFrame:
    """Cache entries not older than their time to live: the newest of each key."""
    return entries.where(F.col(ts) >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {ttl_seconds} SECONDS"))
