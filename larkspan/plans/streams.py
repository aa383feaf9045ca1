"""Streams over the event table, run to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from larkspan.catalog import query
from larkspan.streaming import caches, embedding_queue, running, stateful, windows
from larkspan.streaming import traces as traced
from larkspan.tables import shared_root


@query("ext_tumbling_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def ext_tumbling_windows(spark, d):
    stream = windows.tumbling(windows.read_stream(spark, d, "events"), "1 day", ["event_type"])
    return windows.drain(stream).withColumn("total", F.round("total", 4))


@query("ext_sliding_windows", """
SELECT time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2024-01-01') - s * INTERVAL 12 HOUR AS start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) v(s) GROUP BY 1, 2""")
def ext_sliding_windows(spark, d):
    return windows.drain(windows.sliding(windows.read_stream(spark, d, "events"), "1 day", "12 hours", ["event_type"]))


@query("ext_session_windows", """
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, nth""")
def ext_session_windows(spark, d):
    return windows.sessions(spark.read.parquet(f"{d}/events.parquet"), "6 hours", ["user_id"])


@query("str11_usage_stream", "SELECT user_id, count(*) AS calls, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1")
def str11_usage_stream(spark, d):
    return windows.drain(windows.counters(windows.read_stream(spark, d, "events"), ["user_id"]))


@query("ext_stream_deduplication", "SELECT event_id, user_id FROM events")
def ext_stream_deduplication(spark, d):
    stream = windows.deduplicated(windows.read_stream(spark, d, "events"), ["event_id"], "40 days")
    return windows.drain(stream.select("event_id", "user_id"), "append")


@query("ext_stream_static_join", "SELECT event_id, c_name FROM events JOIN customer ON c_custkey = user_id")
def ext_stream_static_join(spark, d):
    names = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name")
    stream = windows.read_stream(spark, d, "events").join(names, F.col("c_custkey") == F.col("user_id"))
    return windows.drain(stream.select("event_id", "c_name"), "append")


@query("str5_ttl_sweep", "SELECT count(*) AS kept FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY")
def str5_ttl_sweep(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet")
    newest = rows.agg(F.max("ts").alias("newest"))
    return rows.join(F.broadcast(newest)).filter(F.col("ts") >= F.col("newest") - F.expr("INTERVAL 10 DAY")).agg(F.count("*").alias("kept"))


@query("str1_token_bucket_stream")
def str1_token_bucket_stream(spark, d):
    stream = windows.read_stream(spark, d, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    return windows.drain(stateful.token_bucket(stream, "event_type", 10, 10), "append")


@query("str2_sliding_limit_stream")
def str2_sliding_limit_stream(spark, d):
    stream = windows.read_stream(spark, d, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    return windows.drain(stateful.sliding_limit(stream, "event_type", 20, 86_400_000), "append")


def _run(spark, stream):
    return running.run(stream, f"{shared_root(spark)}/larkspan/stream-{uuid.uuid4().hex}")[0]


@query("str8_cache_stream")
def str8_cache_stream(spark, d):
    """Each kind of event has a cache of users, of 100 entries that live a day. Tests hold it against a plain version."""
    return _run(spark, caches.lru_cache(windows.read_stream(spark, d, "events"), "event_type", "user_id", ttl_ms=86_400_000, late="40 days"))


@query("str6_embedding_queue")
def str6_embedding_queue(spark, d):
    """(scope, doc_id, kind, n): what a queue for each source admits of all documents at once, and what it refuses."""
    docs = windows.read_stream(spark, d, "documents").select(F.col("source").alias("scope"), F.col("doc_id").alias("seq"), "doc_id", F.col("text").alias("content"))
    return _run(spark, embedding_queue.queue(docs, served=0)).groupBy("scope", "doc_id", "kind").agg(F.count("*").alias("n"))


@query("str10_trace_sessions", """
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM g),
t AS (SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", user_id, count(*) AS stages, count(*) FILTER (WHERE event_type = 'error') AS failed, CAST(sum(floor(value * 1000)) AS BIGINT) AS total_ms, min(ts) FILTER (WHERE event_type = 'error') AS first_error FROM s GROUP BY user_id, nth)
SELECT * FROM t WHERE "end" <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 1 DAY""")
def str10_trace_sessions(spark, d):
    """Traces that are over by the watermark, from a stream in append mode."""
    stages = windows.read_stream(spark, d, "events").withColumn("duration_ms", F.floor(F.col("value") * 1000).cast("long"))
    return _run(spark, traced.traces(stages, ["user_id"], "6 hours", "1 day", status="event_type")).drop("skipped")
