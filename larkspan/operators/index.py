"""The knowledge index: documents in, chunks and hits out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions.chunks import chunks
from larkspan.operators.fusion import fuse_hits
from larkspan.operators.keyword import keyword_top
from larkspan.operators.nearest import nearest
from larkspan.operators.ranking import top_k_per
from larkspan.operators.rerank import hash_embedding
from larkspan.schemas import SCOPE


def ingest(docs: DataFrame, least: int = 80, most: int = 1200, overlap: int = 120) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) of rows (id, source, title, category, content, ts, scope); blank contents are left out."""
    text = F.trim(F.coalesce("content", F.lit("")))
    source = F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit("inline"))
    kept = docs.filter(text != "").select(
        "id", source.alias("source"), F.coalesce(F.nullif(F.trim("title"), F.lit("")), source).alias("title"),
        F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("general")).alias("category"), text.alias("content"), "ts", *SCOPE,
    ).withColumn("parts", chunks(F.col("content"), least, most, overlap))
    each = kept.select("id", "ts", *SCOPE, F.posexplode("parts").alias("chunk_index", "text"))
    out = each.select(F.concat_ws(":", "id", "chunk_index").alias("chunk_id"), F.col("id").alias("doc_id"), "chunk_index", "text", "ts", *SCOPE)
    return kept.withColumn("chunk_count", F.size("parts")).drop("parts"), out


def embed_chunks(chunks: DataFrame, most: int = 512) -> DataFrame:
    """The chunks (chunk_id, doc_id, chunk_index, text) with `embedding`, of the first `most` characters of each."""
    return chunks.withColumn("embedding", hash_embedding(F.substring("text", 1, most)))


def keyword_hits(queries: DataFrame, texts: DataFrame, k: int, where: Column | None = None, same_group: bool = False) -> DataFrame:
    """(query_id, hit_id, score, rank), see `keyword_top`."""
    return keyword_top(queries, texts, k, where, same_group)


def hybrid(queries: DataFrame, texts: DataFrame, vectors: DataFrame, k: int = 5, over: int = 3, where: Column | None = None, same_group: bool = False) -> DataFrame:
    """(query_id, hit_id, score, matched_by, rank): keyword and vector hits, `over` times as many as wanted, fused.

    queries: (query_id, text, embedding[, grp]), texts: (hit_id, text[, grp]), vectors: (hit_id, embedding[, grp]); `where`
    is over columns that texts and vectors both have. Both halves rank only what a query may see.
    """
    own = ["grp"] if same_group else []
    words = keyword_hits(queries.select("query_id", "text", *own), texts, over * k, where, same_group)
    near = nearest(queries.select("query_id", "embedding", *own), vectors if where is None else vectors.filter(where), over * k, same_group=same_group)
    fused = fuse_hits(words, near).withColumn("score", F.round("score", 9))
    return top_k_per(fused, ["query_id"], [F.col("score").desc(), "hit_id"], k)
