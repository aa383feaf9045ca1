"""Ranking, fusion, thresholds and measures."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspan.catalog import query, table
from larkspan.functions import vectors
from larkspan.operators import evaluation, fusion, ranking
from larkspan.operators.nearest import nearest
from larkspan.plans.bases import base, sub

#: The same page under DuckDB: what `urls.normalize` does to the urls of the test pages.
KEY = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '://www\\.', '://'), '\\?utm_source=[^&]*$', ''), '/+$', '')"


def _deduped() -> str:
    return f"""(SELECT * FROM (SELECT *, {KEY} AS key, row_number() OVER (PARTITION BY query_id, provider, {KEY} ORDER BY provider_ord, pos) AS nth FROM {sub('results')}) WHERE nth = 1)"""


@query("win1_rank_assignment", f"SELECT query_id, provider, page_id, row_number() OVER (PARTITION BY query_id, provider ORDER BY pos) AS rank FROM {sub('results')}")
def win1_rank_assignment(spark, d):
    return ranking.with_rank(base(spark, d, "results"), ["query_id", "provider"], ["pos"]).select("query_id", "provider", "page_id", "rank")


@query("win2_top_k_per_query", f"SELECT query_id, page_id, pos FROM {sub('results')} WHERE provider = 'google' AND pos <= 5")
def win2_top_k_per_query(spark, d):
    rows = ranking.top_k_per(base(spark, d, "results"), ["query_id"], ["pos"], 5, where=F.col("provider") == "google")
    return rows.select("query_id", "page_id", "pos")


@query("agg6_fuse_providers", f"""
SELECT query_id, key, round(sum(1.0 / (60 + pos)), 9) AS score, list(provider ORDER BY provider_ord) AS sources,
  arg_min(page_id, provider_ord * 100000 + pos) AS shown FROM {_deduped()} GROUP BY 1, 2""")
def agg6_fuse_providers(spark, d):
    fused = fusion.fuse_providers(base(spark, d, "results"))
    return fused.select("query_id", "key", F.round("score", 9).alias("score"), "sources", F.regexp_extract("title", r"(\d+)", 1).cast("long").alias("shown"))


def _variants(spark, d):
    lists = base(spark, d, "results")
    return lists.select("query_id", F.col("provider_ord").alias("variant"), "pos", "url", F.array("provider").alias("sources"), F.create_map("provider", "pos").alias("provider_ranks"))


@query("agg7_fuse_variants", f"""
SELECT query_id, key, round(sum(1.0 / (60 + pos)), 9) AS score, list(provider ORDER BY provider_ord) AS sources, min(pos) AS best FROM {_deduped()} GROUP BY 1, 2""")
def agg7_fuse_variants(spark, d):
    fused = fusion.fuse_variants(_variants(spark, d))
    return fused.select("query_id", "key", F.round("score", 9).alias("score"), "sources", F.array_min(F.map_values("provider_ranks")).alias("best"))


@query("agg8_fuse_hits", f"""
WITH a AS (SELECT query_id, page_id AS hit_id, pos AS rank FROM {sub('results')} WHERE provider = 'brave' AND pos <= 15),
b AS (SELECT query_id, page_id AS hit_id, pos AS rank FROM {sub('results')} WHERE provider = 'bing' AND pos <= 15),
u AS (SELECT *, 'keyword' AS kind FROM a UNION ALL SELECT *, 'vector' FROM b)
SELECT query_id, hit_id, round(sum(1.0 / (60 + rank)), 9) AS score, CASE WHEN count(*) > 1 THEN 'hybrid' ELSE min(kind) END AS matched_by FROM u GROUP BY 1, 2""")
def agg8_fuse_hits(spark, d):
    pick = lambda p: base(spark, d, "results").filter((F.col("provider") == p) & (F.col("pos") <= 15)).select("query_id", F.col("page_id").alias("hit_id"), F.col("pos").alias("rank"))
    return fusion.fuse_hits(pick("brave"), pick("bing")).withColumn("score", F.round("score", 9))


@query("agg17_max_normalised", f"""
WITH f AS (SELECT query_id, key, sum(1.0 / (60 + pos)) AS score FROM {_deduped()} GROUP BY 1, 2)
SELECT query_id, key, round(score / max(score) OVER (PARTITION BY query_id), 9) AS share FROM f""")
def agg17_max_normalised(spark, d):
    fused = fusion.fuse_providers(base(spark, d, "results"))
    return fused.select("query_id", "key", F.round(F.col("score") / F.max("score").over(Window.partitionBy("query_id")), 9).alias("share"))


@query("agg18_ordered_dedupe", f"SELECT query_id, provider, key, min(pos) AS pos FROM (SELECT *, {KEY} AS key FROM {sub('results')}) GROUP BY 1, 2, 3")
def agg18_ordered_dedupe(spark, d):
    from larkspan.functions import urls

    keyed = base(spark, d, "results").withColumn("key", urls.normalize(F.col("url")))
    return ranking.first_per(keyed, ["query_id", "provider", "key"], ["pos"]).select("query_id", "provider", "key", "pos")


@query("set7_first_non_empty", f"""
WITH r AS (SELECT *, min(provider_ord) OVER (PARTITION BY query_id) AS low FROM {sub('results')} WHERE contains(url, '/es/') OR provider = 'bing')
SELECT query_id, provider, page_id FROM r WHERE provider_ord = low""")
def set7_first_non_empty(spark, d):
    rows = base(spark, d, "results").filter(F.contains(F.col("url"), F.lit("/es/")) | (F.col("provider") == "bing"))
    return ranking.first_non_empty(rows, ["query_id"], "provider_ord").select("query_id", "provider", "page_id")


@query("win7_source_diversity", f"""
WITH p AS (SELECT query_id, page_id, source, row_number() OVER (PARTITION BY query_id ORDER BY pos, source) AS rank FROM (
  SELECT query_id, page_id, pos, regexp_extract(url, '://([^/?#]+)', 1) AS source FROM {sub('results')} WHERE provider = 'brave')),
s AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS seen FROM p WHERE rank <= 3)
SELECT query_id, page_id, rank FROM s WHERE NOT (rank > 2 AND seen > 1)""")
def win7_source_diversity(spark, d):
    from larkspan.functions import urls

    rows = base(spark, d, "results").filter("provider = 'brave'").withColumn("source", urls.host(F.col("url")))
    ranked = ranking.with_rank(rows, ["query_id"], ["pos", "source"])
    return ranking.diverse(ranked, ["query_id"], "source", "rank").select("query_id", "page_id", "rank")


_COSINE = "round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6)"


@query("fnm1_cosine_similarity", f"SELECT q.vec_id, {_COSINE} AS sim FROM embeddings q JOIN embeddings v ON v.vec_id = q.label")
def fnm1_cosine_similarity(spark, d):
    q = table(spark, d, "embeddings")
    v = q.select(F.col("vec_id").alias("other"), F.col("embedding").alias("other_embedding"))
    return q.join(v, F.col("other") == F.col("label")).select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("other_embedding")), 6).alias("sim"))


@query("fnm2_cosine_distance", f"SELECT q.vec_id, round(1 - {_COSINE}, 6) AS distance FROM embeddings q JOIN embeddings v ON v.vec_id = q.label")
def fnm2_cosine_distance(spark, d):
    return fnm1_cosine_similarity(spark, d).select("vec_id", F.round(1 - F.col("sim"), 6).alias("distance"))


@query("ret2_vector_search", f"""
WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS hit_id, {_COSINE} AS sim FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, hit_id) AS rank FROM s)
SELECT query_id, hit_id, sim, rank FROM r WHERE rank <= 5""")
def ret2_vector_search(spark, d):
    v = table(spark, d, "embeddings")
    asked = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return nearest(asked, v.select(F.col("vec_id").alias("hit_id"), "embedding"), 5)


@query("flt6_namespace_before_top_k", f"""
WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS hit_id, {_COSINE} AS sim FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND v.label = q.label),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, hit_id) AS rank FROM s)
SELECT query_id, hit_id, sim, rank FROM r WHERE rank <= 5""")
def flt6_namespace_before_top_k(spark, d):
    v = table(spark, d, "embeddings").withColumnRenamed("label", "grp")
    asked = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "grp")
    return nearest(asked, v.select(F.col("vec_id").alias("hit_id"), "embedding", "grp"), 5, same_group=True)


@query("fnm4_blended_rank", f"""
WITH f AS (SELECT query_id, key, sum(1.0 / (60 + pos)) AS score, min(page_id) AS page FROM {_deduped()} GROUP BY 1, 2),
m AS (SELECT *, score / max(score) OVER (PARTITION BY query_id) AS share, (page % 10) / 10.0 AS sem FROM f)
SELECT query_id, key, round(0.7 * sem + 0.3 * share, 9) AS blended FROM m""")
def fnm4_blended_rank(spark, d):
    fused = fusion.fuse_providers(base(spark, d, "results").withColumn("title", F.col("page_id").cast("string")))
    low = base(spark, d, "results")
    from larkspan.functions import urls

    page = low.withColumn("key", urls.normalize(F.col("url"))).groupBy("query_id", "key").agg(F.min("page_id").alias("page"))
    share = F.col("score") / F.max("score").over(Window.partitionBy("query_id"))
    return fused.join(page, ["query_id", "key"]).select("query_id", "key", F.round(0.7 * (F.col("page") % 10) / 10 + 0.3 * share, 9).alias("blended"))


def _retrieved(spark, d):
    return base(spark, d, "results").filter("provider = 'brave'").select("query_id", F.col("page_id").alias("id"), F.col("pos").alias("rank"))


def _relevant(spark, d):
    return base(spark, d, "results").filter("provider = 'brave' AND page_id % 3 = 0").select("query_id", F.col("page_id").alias("id"))


_METRICS = f"""
WITH r AS (SELECT query_id, page_id AS id, pos AS rank, page_id % 3 = 0 AS hit FROM {sub('results')} WHERE provider = 'brave'),
t AS (SELECT query_id, count(*) AS relevant FROM r WHERE hit GROUP BY 1),
m AS (SELECT query_id, t.relevant, coalesce(max(1.0 / rank) FILTER (WHERE hit), 0) AS mrr,
  coalesce(count(*) FILTER (WHERE hit AND rank <= 3) / t.relevant, 0) AS recall_3, coalesce(count(*) FILTER (WHERE hit AND rank <= 3) / nullif(count(*) FILTER (WHERE rank <= 3), 0), 0) AS precision_3,
  coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE hit AND rank <= 5), 0) / list_sum(list_transform(range(1, least(t.relevant, 5) + 1), lambda i: 1 / log2(i + 1))) AS ndcg_5
  FROM r JOIN t USING (query_id) GROUP BY query_id, t.relevant)
"""


@query("agg10_retrieval_metrics", _METRICS + "SELECT query_id, relevant, round(mrr, 9) AS mrr, round(recall_3, 9) AS recall_3, round(precision_3, 9) AS precision_3, round(ndcg_5, 9) AS ndcg_5 FROM m")
def agg10_retrieval_metrics(spark, d):
    found = evaluation.query_metrics(_retrieved(spark, d), _relevant(spark, d), [3, 5])
    return found.select("query_id", "relevant", *(F.round(c, 9).alias(c) for c in ("mrr", "recall_3", "precision_3", "ndcg_5")))


@query("agg11_quality_report", _METRICS + "SELECT query_id % 2 AS grp, count(*) AS queries, round(avg(mrr), 9) AS mrr, round(avg(ndcg_5), 9) AS ndcg_5 FROM m GROUP BY GROUPING SETS ((query_id % 2), ())")
def agg11_quality_report(spark, d):
    found = evaluation.query_metrics(_retrieved(spark, d), _relevant(spark, d), [5]).withColumn("grp", F.col("query_id") % 2)
    return evaluation.report(found, ["grp"]).select("grp", "queries", F.round("mrr", 9).alias("mrr"), F.round("ndcg_5", 9).alias("ndcg_5"))


@query("join13_relevance_labels", "SELECT d.source, count(*) AS shown, count(l.doc_id) AS labelled, coalesce(sum(l.quality), 0) AS good FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def join13_relevance_labels(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").withColumn("known", F.lit(1)), "doc_id", "left")
    return joined.groupBy("source").agg(F.count("*").alias("shown"), F.count("known").alias("labelled"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"))


@query("agg9_provider_summary", f"""
WITH a AS {sub('attempts')}, e AS (SELECT provider, error, count(*) AS n, row_number() OVER (PARTITION BY provider ORDER BY count(*) DESC, error) AS rank FROM a WHERE error IS NOT NULL GROUP BY 1, 2),
t AS (SELECT provider, string_agg(error || ' x' || n, '; ' ORDER BY rank) AS top_errors FROM e WHERE rank <= 3 GROUP BY 1)
SELECT a.provider, count(*) AS attempts, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'empty') AS empty, count(*) FILTER (WHERE status = 'error') AS error,
  count(*) FILTER (WHERE status = 'backoff') AS backoff, quantile_disc(duration_ms, 0.5) AS p50_ms, quantile_disc(duration_ms, 0.95) AS p95_ms, round(avg(result_count), 6) AS avg_results,
  round(count(*) FILTER (WHERE status = 'ok') / count(*), 6) AS success_rate, any_value(top_errors) AS top_errors
FROM a LEFT JOIN t USING (provider) GROUP BY 1""")
def agg9_provider_summary(spark, d):
    out = evaluation.provider_summary(base(spark, d, "attempts"))
    return out.withColumn("avg_results", F.round("avg_results", 6)).withColumn("success_rate", F.round("success_rate", 6))


@query("win8_top_errors", f"""
SELECT provider, error, n, rank FROM (SELECT provider, error, count(*) AS n, row_number() OVER (PARTITION BY provider ORDER BY count(*) DESC, error) AS rank FROM {sub('attempts')} WHERE error IS NOT NULL GROUP BY 1, 2) WHERE rank <= 3""")
def win8_top_errors(spark, d):
    counted = base(spark, d, "attempts").filter("error IS NOT NULL").groupBy("provider", "error").agg(F.count("*").alias("n"))
    return ranking.top_k_per(counted, ["provider"], [F.col("n").desc(), "error"], 3)


@query("fnm6_nearest_rank_percentile", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def fnm6_nearest_rank_percentile(spark, d):
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY value)")
    return table(spark, d, "events").groupBy("event_type").agg(p(0.5).alias("p50"), p(0.95).alias("p95"))
