from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.functions.chunks import chunk
from larkspan.operators import index, rerank
from larkspan.plans import pipelines


def test_every_chunk_is_embedded(spark, tmp_path, monkeypatch):
    late = "." * 700 + " " + "late words only here " * 100
    docs = [(1, late), (2, "short"), (3, "word " * 1000), (4, "...")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in pipelines.ret19_embedded_chunks(spark, str(tmp_path)).collect()} == {(1, True), (2, True), (3, True)}
    rows = [(d, i, t) for d, text in docs for i, t in enumerate(chunk(text))]
    got = index.embed_chunks(spark.createDataFrame(rows, "doc_id long, chunk_index int, text string")).collect()
    assert len(got) > len(docs) and all(r.embedding == rerank.hash_vector(r.text[:512]) for r in got)


def test_memo_embeds_texts(spark, tmp_path, monkeypatch):
    rows = [("user", "a b"), ("user", None), ("tool", "a b"), ("tool", "c")]
    spark.createDataFrame(rows, "role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    asked = []
    monkeypatch.setattr(pipelines, "hash_embedding", lambda c: asked.append(c) or F.when(F.coalesce(c, F.lit("")).isin("user", "tool"), F.array()).otherwise(F.array_repeat(F.lit(0.0), 64)))
    assert {tuple(r) for r in pipelines.str9_embedding_memo(spark, str(tmp_path)).collect()} == {("user", 2), ("tool", 2)} and len(asked) == 1
