from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.operators import nearest
from larkspan.plans.retrieval import flt7_similarity_threshold


def test_counts_are_not_cut(spark, tmp_path, monkeypatch):
    """The count comes from no top-k, which would stop at its k."""
    top = nearest.nearest
    monkeypatch.setattr(nearest, "nearest", lambda queries, vectors, k, **more: top(queries, vectors, min(k, 50), **more))
    near = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.when(F.col("id") % 3 == 0, 9.0).otherwise(0.1)).alias("embedding"))
    near.filter("vec_id < 41 OR vec_id % 20 > 0").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.query_id: r.n for r in flt7_similarity_threshold(spark, str(tmp_path)).collect()}
    ids = [i for i in range(3000) if i < 41 or i % 20]
    assert got == {q: sum((i % 3 == 0) == (q % 3 == 0) for i in ids) for q in (0, 20, 40)}
    empty = nearest.count_within(near.limit(0).withColumnRenamed("vec_id", "query_id"), near, 0.5)
    assert empty.count() == 0
