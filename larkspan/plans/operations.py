"""Limiters, breakers, health and usage over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspan.catalog import query, table
from larkspan.operators import admission, limits, sketches
from larkspan.plans.bases import base, sub

_MS = "epoch_ms(ts)"


def _timed(spark, d, name="usage"):
    return base(spark, d, name).withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))


@query("win3_failure_window", f"""
SELECT event_id, c = 5 AND r <= 0.4 AS tripped FROM (SELECT event_id, avg(CASE WHEN status = 'ok' THEN 1.0 ELSE 0 END) OVER w AS r, count(*) OVER w AS c FROM {sub('attempts')}
WINDOW w AS (PARTITION BY provider, user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))""")
def win3_failure_window(spark, d):
    w = Window.partitionBy("provider", "user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    rate = F.avg(F.when(F.col("status") == "ok", 1.0).otherwise(0.0)).over(w)
    return base(spark, d, "attempts").select("event_id", ((F.count("*").over(w) == 5) & (rate <= 0.4)).alias("tripped"))


@query("win10_offered_load", f"SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY {_MS} RANGE BETWEEN 3599999 PRECEDING AND CURRENT ROW) - 1 AS offered FROM {sub('usage')}")
def win10_offered_load(spark, d):
    return limits.offered_load(_timed(spark, d), "user_id", "ms", 3_600_000).select("event_id", "offered")


@query("agg15_health_snapshot", f"""
SELECT provider, count(*) AS recent, count(*) FILTER (WHERE status = 'ok') AS successes, count(*) FILTER (WHERE status <> 'ok') AS failures, round(count(*) FILTER (WHERE status = 'ok') / count(*), 6) AS rate
FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY ts DESC, event_id DESC) AS n FROM {sub('attempts')}) WHERE n <= 5 GROUP BY 1""")
def agg15_health_snapshot(spark, d):
    rows = base(spark, d, "attempts").withColumn("good", F.col("status") == "ok")
    return limits.health(rows, "provider", ["ts", "event_id"], "good").withColumn("rate", F.round("rate", 6))


@query("agg14_usage_counters", f"""
SELECT tenant_id, workspace_id, tool, count(*) AS calls, count(*) FILTER (WHERE ok = 0) AS errors FROM {sub('usage')} GROUP BY ROLLUP (tenant_id, workspace_id, tool)""")
def agg14_usage_counters(spark, d):
    rows = base(spark, d, "usage").withColumn("good", F.col("ok") == 1)
    return limits.usage(rows, ["tenant_id", "workspace_id", "tool"], "good").drop("level")


@query("agg14_usage_overflow", f"""
WITH f AS (SELECT tenant_id, workspace_id, tool, min(event_id) AS first, count(*) AS calls FROM {sub('usage')} GROUP BY ALL)
SELECT tenant_id, workspace_id, tool, calls FROM (SELECT *, row_number() OVER (ORDER BY first) AS n FROM f) WHERE n <= 50 UNION ALL SELECT NULL, NULL, NULL, sum(calls) FROM f""")
def agg14_usage_overflow(spark, d):
    rows = base(spark, d, "usage").withColumn("good", F.col("ok") == 1)
    return limits.usage(rows, ["tenant_id", "workspace_id", "tool"], "good", most=50).filter("level IN (0, 7)").drop("level", "errors")


@query("snk2_status_document", f"SELECT tool, '{{\"tool\":\"' || tool || '\",\"calls\":' || count(*) || ',\"errors\":' || count(*) FILTER (WHERE ok = 0) || '}}' AS document FROM {sub('usage')} GROUP BY 1")
def snk2_status_document(spark, d):
    sums = base(spark, d, "usage").groupBy("tool").agg(F.count("*").alias("calls"), F.count_if(F.col("ok") == 0).alias("errors"))
    return sums.select("tool", F.to_json(F.struct("tool", "calls", "errors")).alias("document"))


@query("str3_concurrency", f"""
WITH e AS (SELECT user_id, {_MS} AS t, 1 AS d FROM events UNION ALL SELECT user_id, {_MS} + CAST(floor(value * 60000) AS BIGINT), -1 FROM events),
r AS (SELECT user_id, sum(d) OVER (PARTITION BY user_id ORDER BY t, d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM e)
SELECT user_id, max(running) AS most_at_once FROM r GROUP BY 1""")
def str3_concurrency(spark, d):
    rows = table(spark, d, "events").withColumn("s", F.unix_millis(F.col("ts").cast("timestamp"))).withColumn("e", F.col("s") + F.floor(F.col("value") * 60000).cast("long"))
    return limits.concurrency(rows, "user_id", "s", "e")


@query("str3_admission")
def str3_admission(spark, d):
    """Limits on what runs at once and on what is admitted in an hour, over all, by tenant, workspace and principal. Refers to
    its own decisions; tests hold it against a replay of all invocations."""
    calls = _timed(spark, d).withColumn("end", F.col("ms") + F.floor(F.col("value") * 60000).cast("long")).withColumnRenamed("user_id", "principal_id")
    rules = admission.four_limits({"global": 400, "tenant": 60, "workspace": 8, "principal": 2}, {"global": 1000, "tenant": 100, "workspace": 12, "principal": 2}, 3_600_000)
    return admission.admit(calls, rules, "ms", "end")


@query("flt16_available_providers", f"""
WITH l AS (SELECT provider, avg(CASE WHEN status = 'ok' THEN 1.0 ELSE 0 END) AS rate FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY ts DESC, event_id DESC) AS n FROM {sub('attempts')}) WHERE n <= 5 GROUP BY 1)
SELECT DISTINCT provider FROM events, (SELECT event_type AS provider FROM events) WHERE provider NOT IN (SELECT provider FROM l WHERE rate <= 0.4)""".replace("FROM events, (SELECT event_type AS provider FROM events)", "FROM (SELECT event_type AS provider FROM events)"))
def flt16_available_providers(spark, d):
    rows = base(spark, d, "attempts").withColumn("good", F.col("status") == "ok")
    off = limits.health(rows, "provider", ["ts", "event_id"], "good").filter("rate <= 0.4").select("provider")
    return rows.select("provider").distinct().join(off, "provider", "left_anti")


@query("str1_token_bucket")
def str1_token_bucket(spark, d):
    """Refers to its own decisions; tests hold it against a plain version."""
    return limits.token_bucket(_timed(spark, d), "tool", "ms", "event_id", 10, 10)


@query("str2_sliding_limit")
def str2_sliding_limit(spark, d):
    return limits.sliding_limit(_timed(spark, d), "workspace_id", "ms", "event_id", 20, 86_400_000)


@query("str4_circuit_breaker")
def str4_circuit_breaker(spark, d):
    return limits.circuit_breaker(_timed(spark, d, "attempts"), "user_id", "ms", "event_id", "status")


@query("str10_request_traces", "SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS stages, count(*) FILTER (WHERE event_type = 'error') AS failed, round(sum(value), 4) AS duration FROM events GROUP BY 1, 2")
def str10_request_traces(spark, d):
    return table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("stages"), F.count_if(F.col("event_type") == "error").alias("failed"), F.round(F.sum("value"), 4).alias("duration"))


@query("fnj1_json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def fnj1_json_fields(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("fna1_array_functions", "SELECT vec_id, list_position(l, 2) AS at, l[2:3] AS part, list_reverse(l) AS back FROM (SELECT vec_id, [label, 2, label + 1] AS l FROM embeddings)")
def fna1_array_functions(spark, d):
    items = F.array("label", F.lit(2), F.col("label") + 1)
    return table(spark, d, "embeddings").select("vec_id", F.array_position(items, F.lit(2)).cast("int").alias("at"), F.slice(items, 2, 2).alias("part"), F.reverse(items).alias("back"))


@query("fna2_map_minimum", "SELECT user_id, min(value) FILTER (WHERE event_type = 'click') AS click, min(value) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY 1")
def fna2_map_minimum(spark, d):
    low = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("value").alias("v")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))
    return low.select("user_id", F.col("m")["click"].alias("click"), F.col("m")["view"].alias("view"))


@query("agg2_distinct_sketches")
def agg2_distinct_sketches(spark, d):
    """Users and values of each kind of event from sketches of its days; approximate, so tests hold the error."""
    days = sketches.daily(table(spark, d, "events"), ["event_type"], "ts", "user_id", "value")
    return sketches.estimates(sketches.merged(days, ["event_type"]), ["event_type"])
