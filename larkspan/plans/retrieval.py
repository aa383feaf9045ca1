"""Keyword, vector and hybrid search, and the caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.catalog import query, table
from larkspan.functions.text import index_tokens
from larkspan.operators import cache, index, keyword, ranking
from larkspan.plans.bases import base, sub
from larkspan.plans.indexes import documents_index

_SPLIT = "list_filter(string_split_regex(strip_accents(lower({c})), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"

BM25_SQL = f"""
WITH tok AS (SELECT doc_id, source, {_SPLIT.format(c="coalesce(text, '')")} AS t FROM documents),
stats AS (SELECT count(*) AS n_texts, avg(len(t)) AS avg_len FROM tok),
post AS (SELECT doc_id, doc_len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS doc_len, unnest(t) AS term FROM tok) GROUP BY ALL),
raw AS (SELECT item_id, list_filter(string_split_regex(text, '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '') AS r FROM benchmark),
each AS (SELECT item_id, len(r) AS n, unnest(range(1, len(r) + 1)) AS place, unnest(r) AS w FROM raw),
qt AS (SELECT item_id, place, place = n AS prefix, unnest({_SPLIT.format(c='w')}) AS term FROM each),
met AS (SELECT q.item_id, q.place, q.term, p.doc_id, p.doc_len, sum(p.tf) AS f FROM qt q JOIN post p ON p.term = q.term WHERE NOT prefix GROUP BY ALL
  UNION ALL SELECT q.item_id, q.place, q.term, p.doc_id, p.doc_len, sum(p.tf) AS f FROM qt q JOIN post p ON starts_with(p.term, q.term) WHERE prefix GROUP BY ALL),
freq AS (SELECT item_id, place, term, count(*) AS n FROM met GROUP BY ALL),
scored AS (SELECT m.item_id AS query_id, m.doc_id AS hit_id,
  round(sum(greatest(ln((n_texts - n + 0.5) / (n + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * doc_len / avg_len))), 6) AS score
  FROM met m JOIN freq USING (item_id, place, term), stats GROUP BY ALL)
"""

_RANKED = ", {name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hit_id) AS rank FROM {of})"


def _texts(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("hit_id"), F.coalesce("text", F.lit("")).alias("text"), "source")


def _queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("fns3_index_tokens", f"SELECT doc_id, len(t) AS n, list_sort(list_distinct(t)) AS terms FROM (SELECT doc_id, {_SPLIT.format(c='text')} AS t FROM documents)")
def fns3_index_tokens(spark, d):
    tokens = table(spark, d, "documents").select("doc_id", index_tokens(F.col("text")).alias("t"))
    return tokens.select("doc_id", F.size("t").cast("long").alias("n"), F.array_sort(F.array_distinct("t")).alias("terms"))


@query("agg19_corpus_statistics", f"SELECT count(*) AS n_texts, round(avg(len({_SPLIT.format(c='text')})), 6) AS avg_len FROM documents")
def agg19_corpus_statistics(spark, d):
    return keyword.statistics(_texts(spark, d)).withColumn("avg_len", F.round("avg_len", 6))


@query("join1_postings", f"SELECT doc_id AS hit_id, term, count(*) AS tf, doc_len FROM (SELECT doc_id, len(t) AS doc_len, unnest(t) AS term FROM (SELECT doc_id, {_SPLIT.format(c='text')} AS t FROM documents)) GROUP BY ALL")
def join1_postings(spark, d):
    """From the stored index."""
    return documents_index(spark, d).postings().select("hit_id", "term", F.col("tf").cast("long").alias("tf"), F.col("doc_len").cast("long").alias("doc_len"))


@query("ret1_keyword_search", BM25_SQL + _RANKED.format(name="r", of="scored") + " SELECT query_id, hit_id, score, rank FROM r WHERE rank <= 15")
def ret1_keyword_search(spark, d):
    return index.keyword_hits(_queries(spark, d), documents_index(spark, d), 15).select("query_id", "hit_id", "score", "rank")


@query("flt2_source_filter", BM25_SQL + ", own AS (SELECT s.* FROM scored s JOIN documents d ON d.doc_id = s.hit_id WHERE d.source = 'src1')" + _RANKED.format(name="r", of="own") + " SELECT query_id, hit_id, score, rank FROM r WHERE rank <= 5")
def flt2_source_filter(spark, d):
    """The filter comes before the ranking; the statistics stay those of the whole index."""
    return index.keyword_hits(_queries(spark, d), documents_index(spark, d), 5, F.col("source") == "src1").select("query_id", "hit_id", "score", "rank")


_VECTORS = """, near AS (SELECT q.vec_id AS query_id, v.vec_id AS hit_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings q JOIN benchmark b ON b.item_id = q.vec_id, embeddings v)"""


_FUSED = """,
u AS (SELECT query_id, hit_id, rank, 'keyword' AS kind FROM w WHERE rank <= 15 UNION ALL SELECT query_id, hit_id, rank, 'vector' FROM n WHERE rank <= 15),
fused AS (SELECT query_id, hit_id, round(sum(1.0 / (60 + rank)), 9) AS score, CASE WHEN count(*) > 1 THEN 'hybrid' ELSE min(kind) END AS matched_by FROM u GROUP BY 1, 2)"""


@query("ret3_hybrid_search", BM25_SQL + _VECTORS + _RANKED.format(name="w", of="scored") + _RANKED.format(name="n", of="near") + _FUSED + _RANKED.format(name="r", of="fused") + " SELECT query_id, hit_id, score, matched_by, rank FROM r WHERE rank <= 5")
def ret3_hybrid_search(spark, d):
    v = table(spark, d, "embeddings")
    asked = _queries(spark, d).join(v.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "left")
    return index.hybrid(asked, documents_index(spark, d), v.select(F.col("vec_id").alias("hit_id"), "embedding"), 5)


_NOW = 1700000000000 + 400 * 60000


@query("ret4_semantic_cache", f"""
WITH v AS {sub('vectors')}, s AS (SELECT q.vec_id AS query_id, e.vec_id AS hit_id, e.ts, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS sim
  FROM v q JOIN v e ON q.vec_id % 20 = 0 AND q.label = e.label),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, hit_id) AS rank FROM s),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM r WHERE rank <= 5 AND sim >= 0.2 AND {_NOW} - ts <= 3600000 * 5)
SELECT query_id, hit_id, sim FROM g WHERE nth = 1""")
def ret4_semantic_cache(spark, d):
    v = base(spark, d, "vectors").withColumnRenamed("label", "grp")
    entries = v.select(F.col("vec_id").alias("hit_id"), "embedding", "grp", "ts", F.lit(3600000 * 5).alias("ttl_ms"))
    return cache.cached(v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "grp"), entries, F.lit(_NOW), threshold=0.2)


@query("flt7_similarity_threshold", """
SELECT q.vec_id AS query_id, count(*) AS n FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0
AND round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) >= 0.75 GROUP BY 1""")
def flt7_similarity_threshold(spark, d):
    from larkspan.operators.nearest import count_within

    v = table(spark, d, "embeddings")
    return count_within(v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v, 0.75)


@query("ret5_cache_upsert", f"""
WITH c AS (SELECT *, row_number() OVER (PARTITION BY execution_mode, tenant_id, workspace_id, lower(topic) ORDER BY ts DESC, seq DESC) AS nth FROM {sub('notes')})
SELECT execution_mode, tenant_id, workspace_id, lower(topic) AS query, ts FROM c WHERE nth = 1""")
def ret5_cache_upsert(spark, d):
    rows = base(spark, d, "notes").select("execution_mode", "tenant_id", "workspace_id", F.lit("ns").alias("namespace"), F.col("topic").alias("query"), "ts")
    old, new = rows.filter("ts % 2 = 0"), rows.filter("ts % 2 = 1").withColumn("query", F.upper("query"))
    return cache.remember(old, new).select("execution_mode", "tenant_id", "workspace_id", F.lower("query").alias("query"), "ts")


@query("flt8_content_ttl", f"""
SELECT page_id FROM {sub('cache')} WHERE 1700000000000 + 200 * 3600000 - ts <= CASE category WHEN 'docs' THEN 2592000000 WHEN 'news' THEN 3600000 WHEN 'blog' THEN 432000000 ELSE 604800000 END""")
def flt8_content_ttl(spark, d):
    pages = base(spark, d, "cache")
    return cache.content(pages, pages, F.lit(1700000000000 + 200 * 3600000)).select("page_id")


@query("srt1_over_fetch", BM25_SQL + _RANKED.format(name="r", of="scored") + " SELECT query_id, count(*) AS n FROM r WHERE rank <= 15 GROUP BY 1")
def srt1_over_fetch(spark, d):
    return ret1_keyword_search(spark, d).groupBy("query_id").agg(F.count("*").alias("n"))


@query("srt7_stable_ties", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS nth FROM lineitem")
def srt7_stable_ties(spark, d):
    return ranking.with_rank(table(spark, d, "lineitem"), ["l_orderkey"], [F.col("l_quantity").desc(), "l_linenumber"], "nth").select("l_orderkey", "l_linenumber", "nth")


@query("ret6_embedding_rerank", """
WITH a AS (SELECT q.vec_id AS query_id, v.vec_id AS hit_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS sim FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND v.label = q.label),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, hit_id) AS near FROM a),
s AS (SELECT *, 1.0 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY hit_id)) AS fusion FROM c WHERE near <= 20),
b AS (SELECT query_id, hit_id, round(0.7 * sim + 0.3 * fusion / max(fusion) OVER (PARTITION BY query_id), 6) AS blended FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY blended DESC, hit_id) AS rank FROM b)
SELECT query_id, hit_id, blended, rank FROM r WHERE rank <= 5""")
def ret6_embedding_rerank(spark, d):
    from larkspan.operators.nearest import nearest
    from larkspan.operators.rerank import blend

    v = table(spark, d, "embeddings").withColumnRenamed("label", "grp")
    near = nearest(v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "grp"), v.select(F.col("vec_id").alias("hit_id"), "embedding", "grp"), 20, same_group=True)
    placed = ranking.with_rank(near.drop("rank"), ["query_id"], ["hit_id"], "pos").withColumn("fusion", 1.0 / (60 + F.col("pos")))
    return blend(placed, 5).select("query_id", "hit_id", "blended", "rank")


@query("ret7_scorer_rerank", """
WITH s AS (SELECT query_id, page_id, length(title) - pos AS score FROM (SELECT page_id % 40 AS query_id, page_id, concat('Page ', CAST(page_id AS STRING)) AS title, row_number() OVER (PARTITION BY page_id % 40 ORDER BY (page_id * 7) % 997, page_id) AS pos FROM pages))
SELECT query_id, page_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) AS rank FROM s) WHERE rank <= 3""")
def ret7_scorer_rerank(spark, d):
    from larkspan.operators.rerank import rerank

    rows = base(spark, d, "results").filter("provider = 'brave'").withColumn("text", F.concat_ws("|", "title", "pos"))
    scorer = lambda texts: [len(t.split("|")[0]) - int(t.split("|")[1]) for t in texts]
    return rerank(rows, "text", scorer, ["query_id"], ["page_id"], 3).select("query_id", "page_id", "rank")


@query("fnm5_score_normalise", "SELECT vec_id, [list_max(CAST(embedding AS DOUBLE[])[1:2]), 0.0, 0.0] AS scores FROM embeddings")
def fnm5_score_normalise(spark, d):
    from larkspan.operators.rerank import normalise_scores

    logits = F.array(F.slice(F.col("embedding").cast("array<double>"), 1, 2))
    return table(spark, d, "embeddings").select("vec_id", normalise_scores(logits, 3).alias("scores"))
