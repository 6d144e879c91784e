"""File events as streams and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.plans.registry import query
from tessella.plans.shared import fresh_path
from tessella.streaming import watch as W


@query("event_filter", "SELECT event_id, event_type FROM events WHERE event_type IS DISTINCT FROM 'view'")
def event_filter(t):
    return W.wanted(t("events"), ["view"]).select("event_id", "event_type")


@query("debounce_sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS last_us, count(*) AS events FROM g GROUP BY user_id, k""")
def debounce_sessions(t):
    return W.debounce(t("events"), "10 minutes").select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("last").alias("last_us"), "events")


@query("ttl_cache", "SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id HAVING max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def ttl_cache(t):
    newest = t("events").groupBy("user_id").agg(F.max("ts").alias("ts"))
    now = newest.agg(F.max("ts").alias("t")).first()["t"]
    return W.live(newest, str(now), 3600)


@query("stream_file_events", "SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY event_type")
def stream_file_events(t):
    """A stream over the event files: read until all are seen, written as a table, then counted."""
    events = t("events")
    spark = events.sparkSession
    source = fresh_path(spark, "event-source")
    events.write.parquet(source)
    out = fresh_path(spark, "event-stream")
    stream = W.wanted(W.read_events(spark, source, events.schema), ["view"])
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(events.schema).parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("stream_debounce", """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e), b AS (SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS events FROM g GROUP BY user_id, k)
 SELECT user_id, epoch_us(start) AS start_us, epoch_us(last) AS last_us, events FROM b WHERE last + INTERVAL 10 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE""")
def stream_debounce(t):
    """Bursts from a stream: those that the watermark has passed at the end; the ones still open aren't emitted yet."""
    events = t("events")
    spark = events.sparkSession
    source = fresh_path(spark, "event-source")
    events.write.parquet(source)
    out = fresh_path(spark, "bursts")
    bursts = W.debounce(W.read_events(spark, source, events.schema), "10 minutes")
    q = bursts.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(bursts.schema).parquet(out).select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("last").alias("last_us"), "events")
