"""Scopes, ingest, changes to tables, evictions and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.catalog import query, table
from larkspan.operators import changes, index, notes, ranking
from larkspan.plans.bases import base, sub
from larkspan.schemas import DOCS, conform, in_scope

_S = "execution_mode, tenant_id, workspace_id"


@query("flt1_scope_filter", f"SELECT doc_id, n_chars FROM {sub('docs')} WHERE execution_mode = 'hosted' AND tenant_id = 't1' AND workspace_id = 'w3'")
def flt1_scope_filter(spark, d):
    return in_scope(base(spark, d, "docs"), "hosted", "t1", "w3").select("doc_id", "n_chars")


@query("agg1_scoped_counts", f"SELECT {_S}, count(*) AS n FROM {sub('docs')} GROUP BY ALL")
def agg1_scoped_counts(spark, d):
    return base(spark, d, "docs").groupBy("execution_mode", "tenant_id", "workspace_id").agg(F.count("*").alias("n"))


@query("agg2_sessions", f"SELECT {_S}, count(*) AS n, count(DISTINCT session) AS sessions FROM {sub('notes')} GROUP BY ALL")
def agg2_sessions(spark, d):
    return base(spark, d, "notes").groupBy("execution_mode", "tenant_id", "workspace_id").agg(F.count("*").alias("n"), F.countDistinct("session").alias("sessions"))


@query("win4_keep_newest", f"SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY {_S} ORDER BY ts DESC, seq DESC) AS n FROM {sub('notes')}) WHERE n <= 20")
def win4_keep_newest(spark, d):
    return notes.evict(base(spark, d, "notes"), 20).select("id")


@query("win5_latest_per_source", f"SELECT source, arg_max(doc_id, ts * 1000000 + doc_id) AS doc_id FROM {sub('docs')} GROUP BY 1")
def win5_latest_per_source(spark, d):
    return ranking.latest_per(base(spark, d, "docs").select("source", "doc_id", "ts"), ["source"], ["ts", "doc_id"]).select("source", "doc_id")


@query("win6_recent_history", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20")
def win6_recent_history(spark, d):
    return ranking.top_k_per(table(spark, d, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 20).select("event_id", "user_id")


@query("win9_lru_eviction", f"""
SELECT tenant_id, workspace_id FROM (SELECT tenant_id, workspace_id, row_number() OVER (PARTITION BY tenant_id ORDER BY max(ts) DESC, workspace_id) AS n FROM {sub('usage')} GROUP BY 1, 2) WHERE n <= 4""")
def win9_lru_eviction(spark, d):
    last = base(spark, d, "usage").groupBy("tenant_id", "workspace_id").agg(F.max("ts").alias("at"))
    return ranking.top_k_per(last, ["tenant_id"], [F.col("at").desc(), "workspace_id"], 4).select("tenant_id", "workspace_id")


@query("prj1_list_without_content", f"SELECT doc_id, source, category, ts FROM {sub('docs')}")
def prj1_list_without_content(spark, d):
    return base(spark, d, "docs").select("doc_id", "source", "category", "ts")


@query("prj2_hydrated_tags", f"SELECT id, CASE WHEN seq % 3 = 0 THEN [topic, 'x'] ELSE [] END AS tags FROM {sub('notes')}")
def prj2_hydrated_tags(spark, d):
    stored = F.when(F.col("seq") % 3 == 0, F.to_json(F.array("topic", F.lit("x")))).when(F.col("seq") % 3 == 1, F.lit("broken["))
    return base(spark, d, "notes").select("id", F.coalesce(F.from_json(stored, "array<string>"), F.array().cast("array<string>")).alias("tags"))


@query("prj3_optional_fields", """SELECT event_id, '{"event_id":' || event_id || CASE WHEN value > 60 THEN ',"error":"late"}' ELSE '}' END AS payload FROM events""")
def prj3_optional_fields(spark, d):
    return table(spark, d, "events").select("event_id", F.to_json(F.struct("event_id", F.when(F.col("value") > 60, "late").alias("error"))).alias("payload"))


@query("prj4_freshness_text", f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'fetched live' ELSE 'from cache' END || '; indexed ' || strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS note FROM {sub('docs')}")
def prj4_freshness_text(spark, d):
    status = F.when(F.col("doc_id") % 2 == 0, "fetched live").otherwise("from cache")
    return base(spark, d, "docs").select("doc_id", F.concat_ws("; ", status, F.concat(F.lit("indexed "), F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd"))).alias("note"))


@query("prj5_provider_notes", f"SELECT user_id, string_agg(provider || ' ' || status, '; ' ORDER BY event_id) AS notes FROM {sub('attempts')} WHERE status <> 'ok' GROUP BY 1")
def prj5_provider_notes(spark, d):
    odd = base(spark, d, "attempts").filter("status <> 'ok'").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.concat_ws(" ", "provider", "status").alias("s")))).alias("l"))
    return odd.select("user_id", F.array_join(F.transform("l", lambda x: x["s"]), "; ").alias("notes"))


@query("prj6_listing_lines", f"SELECT {_S}, string_agg(n || '. ' || source || ' [' || doc_id || ']', chr(10) ORDER BY n) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY {_S} ORDER BY ts DESC, doc_id DESC) AS n FROM {sub('docs')}) WHERE n <= 50 GROUP BY ALL")
def prj6_listing_lines(spark, d):
    keys = ["execution_mode", "tenant_id", "workspace_id"]
    top = ranking.top_k_per(base(spark, d, "docs").drop("content"), keys, [F.col("ts").desc(), F.col("doc_id").desc()], 50)
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("source"), F.lit(" ["), F.col("doc_id").cast("string"), F.lit("]"))
    return top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l")).select(*keys, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("lines"))


@query("snk1_json_results", """SELECT page_id, '{"page_id":' || page_id || ',"url":"' || url || '"}' AS payload FROM pages""")
def snk1_json_results(spark, d):
    return table(spark, d, "pages").select("page_id", F.to_json(F.struct("page_id", "url")).alias("payload"))


@query("agg20_text_aggregation", "SELECT conv_id, string_agg(role, ' ' ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def agg20_text_aggregation(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.expr("listagg(role, ' ') WITHIN GROUP (ORDER BY turn)").alias("roles"))


@query("src1_ingested_documents", f"SELECT CAST(doc_id AS VARCHAR) AS id, source, category, length(trim(content, ' ')) AS chars FROM {sub('docs')} WHERE trim(content, ' ') <> ''")
def src1_ingested_documents(spark, d):
    docs = base(spark, d, "docs").withColumn("id", F.col("doc_id").cast("string")).withColumn("title", F.lit(None).cast("string"))
    kept, _ = index.ingest(docs)
    return kept.select("id", "source", "category", F.length("content").cast("long").alias("chars"))


@query("src1_ingested_chunks")
def src1_ingested_chunks(spark, d):
    docs = base(spark, d, "docs").withColumn("id", F.col("doc_id").cast("string")).withColumn("title", F.lit(None).cast("string"))
    return index.ingest(docs)[1].select("chunk_id", "doc_id", "chunk_index", "text")


@query("ddl1_additive_schema", "SELECT CAST(doc_id AS VARCHAR) AS id, source, 'local' AS execution_mode, 'local' AS tenant_id, 'local' AS workspace_id, CAST(NULL AS INTEGER) AS chunk_count FROM documents")
def ddl1_additive_schema(spark, d):
    old = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source")
    return conform(old, DOCS).select("id", "source", "execution_mode", "tenant_id", "workspace_id", "chunk_count")


_OLD = "(SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS v FROM orders WHERE o_orderpriority <> '1-URGENT')"
_NEW = "(SELECT o_orderkey AS k, upper(o_orderpriority) AS s, o_totalprice + 1 AS v FROM orders WHERE o_orderstatus = 'F')"


def _old_new(spark, d):
    o = table(spark, d, "orders")
    old = o.filter("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("v"))
    return old, o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.upper("o_orderpriority").alias("s"), (F.col("o_totalprice") + 1).alias("v"))


@query("dml2_replace_by_key", f"SELECT k, s, v FROM {_NEW} UNION ALL SELECT * FROM {_OLD} WHERE k NOT IN (SELECT k FROM {_NEW})")
def dml2_replace_by_key(spark, d):
    old, new = _old_new(spark, d)
    return changes.upsert(old.withColumn("at", F.lit(0)), new.withColumn("at", F.lit(1)), ["k"], "at").drop("at")


@query("dml3_additive_upsert", f"SELECT k, coalesce(o.s, n.s) AS s, round(coalesce(o.v, 0) + coalesce(n.v, 0), 2) AS v FROM {_OLD} o FULL JOIN {_NEW} n USING (k)")
def dml3_additive_upsert(spark, d):
    old, new = _old_new(spark, d)
    return changes.upsert_add(old, new, ["k"], "v", "s").withColumn("v", F.round("v", 2))


@query("dml4_insert_if_absent", f"SELECT * FROM {_OLD} UNION ALL SELECT * FROM {_NEW} WHERE k NOT IN (SELECT k FROM {_OLD})")
def dml4_insert_if_absent(spark, d):
    return changes.insert_absent(*_old_new(spark, d), ["k"])


@query("dml5_replace_by_document", f"SELECT * FROM {_NEW} UNION ALL SELECT * FROM {_OLD} WHERE k NOT IN (SELECT k FROM {_NEW})")
def dml5_replace_by_document(spark, d):
    return changes.replace_by(*_old_new(spark, d), ["k"])


@query("dml1_append", f"SELECT * FROM {_OLD} UNION ALL SELECT * FROM {_NEW}")
def dml1_append(spark, d):
    old, new = _old_new(spark, d)
    return old.unionByName(new)


@query("dml6_cascade_delete", "SELECT 'lineitem' AS t, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderstatus <> 'F'")
def dml6_cascade_delete(spark, d):
    orders, line = table(spark, d, "orders"), table(spark, d, "lineitem")
    gone = orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    left = changes.cascade({"lineitem": (line, "l_orderkey"), "orders": (orders, "o_orderkey")}, gone, "id")
    return left["lineitem"].agg(F.count("*").alias("n")).select(F.lit("lineitem").alias("t"), "n").unionByName(left["orders"].agg(F.count("*").alias("n")).select(F.lit("orders").alias("t"), "n"))


@query("join9_semi_join_delete", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def join9_semi_join_delete(spark, d):
    gone = table(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    return changes.delete_by(table(spark, d, "lineitem"), gone, ["l_partkey"]).select("l_orderkey", "l_linenumber")


@query("dml7_clear_session", f"SELECT id FROM {sub('notes')} WHERE NOT (session = '3' OR topic = 'system')")
def dml7_clear_session(spark, d):
    return base(spark, d, "notes").filter(~((F.col("session") == "3") | (F.col("topic") == "system"))).select("id")


@query("dml8_ttl_purge", f"SELECT page_id FROM {sub('cache')} WHERE ts >= 1700000000000 + 150 * 3600000 - 360000000")
def dml8_ttl_purge(spark, d):
    return changes.purge(base(spark, d, "cache"), "ts", 1700000000000 + 150 * 3600000, 360000000).select("page_id")


@query("dml9_soft_delete", f"SELECT principal_id, CASE WHEN revoked_at IS NOT NULL THEN revoked_at WHEN segment = 'BUILDING' THEN TIMESTAMP '2024-02-01' END AS revoked_at FROM {sub('memberships')}")
def dml9_soft_delete(spark, d):
    rows = base(spark, d, "memberships")
    return changes.soft_delete(rows, F.col("segment") == "BUILDING", "revoked_at", F.lit("2024-02-01").cast("timestamp")).select("principal_id", "revoked_at")


@query("dml10_change_capture", f"""
SELECT k, CASE WHEN o.k IS NULL THEN 'insert' WHEN n.k IS NULL THEN 'delete' ELSE 'update' END AS action FROM {_OLD} o FULL JOIN {_NEW} n USING (k) WHERE o.s IS DISTINCT FROM n.s OR o.v IS DISTINCT FROM n.v""")
def dml10_change_capture(spark, d):
    return changes.capture(*_old_new(spark, d), ["k"]).select("k", "action")


@query("join8_ownership", f"SELECT v.vec_id FROM {sub('vectors')} v WHERE EXISTS (SELECT 1 FROM {sub('docs')} d WHERE d.doc_id = v.vec_id AND d.tenant_id = v.tenant_id AND d.workspace_id = v.workspace_id)")
def join8_ownership(spark, d):
    owner = base(spark, d, "docs").select(F.col("doc_id").alias("vec_id"), "tenant_id", "workspace_id")
    return base(spark, d, "vectors").join(owner, ["vec_id", "tenant_id", "workspace_id"], "left_semi").select("vec_id")


@query("join10_not_indexed_yet", "SELECT page_id FROM pages WHERE regexp_extract(url, '://([^/?#.]+)', 1) NOT IN (SELECT source FROM documents)")
def join10_not_indexed_yet(spark, d):
    known = table(spark, d, "documents").select(F.col("source").alias("first")).distinct()
    return table(spark, d, "pages").withColumn("first", F.regexp_extract("url", r"://([^/?#.]+)", 1)).join(known, "first", "left_anti").select("page_id")


@query("src22_content_cache", f"SELECT url, arg_max(page_id, ts * 100000 + page_id) AS page_id FROM {sub('cache')} GROUP BY 1")
def src22_content_cache(spark, d):
    return ranking.latest_per(base(spark, d, "cache").select("url", "page_id", "ts"), ["url"], ["ts", "page_id"]).select("url", "page_id")


@query("ret20_lookup_by_source", f"SELECT source, arg_max(doc_id, ts) AS doc_id, arg_max(category, ts) AS category FROM {sub('docs')} WHERE source IN ('src1', 'src2', 'src3') GROUP BY 1")
def ret20_lookup_by_source(spark, d):
    docs = base(spark, d, "docs").filter(F.col("source").isin("src1", "src2", "src3")).select("source", "doc_id", "category", "ts")
    return ranking.latest_per(docs, ["source"], ["ts"]).select("source", "doc_id", "category")


@query("srt5_clamped_limits", "SELECT event_id, CASE WHEN event_id = 0 THEN 1 ELSE least(event_id, 500) END AS limit_used FROM events")
def srt5_clamped_limits(spark, d):
    return table(spark, d, "events").select("event_id", F.least(F.greatest(F.col("event_id"), F.lit(1)), F.lit(500)).alias("limit_used"))


@query("src24_json_lines", "SELECT item_id, text FROM benchmark")
def src24_json_lines(spark, d):
    rows = table(spark, d, "benchmark")
    return rows.select(F.from_json(F.to_json(F.struct("item_id", "text")), rows.schema).alias("r")).select("r.*")
