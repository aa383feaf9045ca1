"""Nearest vectors by cosine, in blocks of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.operators.best import Best
from larkspan.operators.ranking import top_k_per


def nearest(queries: DataFrame, vectors: DataFrame, k: int, block: int = 4096, same_group: bool = False, least: float | None = None) -> DataFrame:
    """(query_id, hit_id, sim, rank): the k vectors most like each query, by similarity rounded to six places, then id.

    queries: (query_id, embedding[, grp]), vectors: (hit_id, embedding[, grp]); with same_group a query only sees vectors
    of its group, before anything is ranked; with `least` only vectors that like it. Queries go to the executors in blocks
    of bounded size, one after the other; the vectors stay where they lie, are compared in tiles, and each task sends k
    rows a query. Vectors of another length have no similarity.
    """
    columns = ["query_id", F.col("embedding").cast("array<double>").alias("embedding"), *([F.col("grp").cast("string").alias("grp")] if same_group else [])]
    asked = queries.select(*columns).filter("embedding IS NOT NULL")
    # Dealt by hash, so that a block has about as many queries as the parameter says whatever their number.
    blocks = max(1, -(-asked.count() // block))
    pool = vectors.select("hit_id", F.col("embedding").cast("array<double>").alias("embedding"), (F.col("grp") if same_group else F.lit(None)).cast("string").alias("grp"))
    out = None
    for number in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number).collect()
        found = _block(pool, rows, asked.schema["query_id"].dataType.simpleString(), k, same_group, -np.inf if least is None else least)
        out = found if out is None else out.unionByName(found)
    return top_k_per(out, ["query_id"], [F.col("sim").desc(), "hit_id"], k)


#: Queries and vectors that are compared at once.
_TILE = 1024


def _block(pool: DataFrame, rows: list, query_type: str, k: int, same_group: bool, least: float) -> DataFrame:
    names = [r["query_id"] for r in rows]
    groups = np.array([r["grp"] if same_group else None for r in rows], object)
    sent = pool.sparkSession.sparkContext.broadcast((names, groups, [list(r["embedding"]) for r in rows]))
    hit_type = pool.schema["hit_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, groups, values = sent.value
        asked = {}
        for length in {len(v) for v in values}:
            mine = np.array([i for i, v in enumerate(values) if len(v) == length])
            asked[length] = mine, np.array([values[i] for i in mine], float)
        best = Best(k)
        for batch in batches:
            ids, own = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            their = np.array(batch.column(2).to_pylist(), object)
            for length, (mine, a) in asked.items():
                here = np.array([i for i, v in enumerate(own) if v is not None and len(v) == length and None not in v], np.int64)
                for at in range(0, len(here), _TILE):
                    cut = here[at : at + _TILE]
                    b = np.array([own[i] for i in cut], float)
                    for first in range(0, len(mine), _TILE):
                        part, q = a[first : first + _TILE], mine[first : first + _TILE]
                        size = np.linalg.norm(part, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
                        sim = np.round(np.divide(part @ b.T, size, out=np.zeros_like(size), where=size > 0), 6) + 0.0
                        if same_group:
                            sim[groups[q][:, None] != their[cut][None, :]] = -np.inf
                        sim[sim < least] = -np.inf
                        best.add_matrix(q, ids[cut], sim)
        query, ids, score = best.rows()
        if len(query):
            yield pa.RecordBatch.from_arrays([pa.array([names[q] for q in query]), pa.array(ids), pa.array(score)], ["query_id", "hit_id", "sim"])

    return pool.mapInArrow(run, f"query_id {query_type}, hit_id {hit_type}, sim double")


def count_within(queries: DataFrame, vectors: DataFrame, least: float, block: int = 4096) -> DataFrame:
    """(query_id, n): how many vectors have a similarity, rounded to six places, of `least` or more to each query; queries
    without any are left out. Tasks count what they hold, in pieces of bounded size, and the counts are added up."""
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).filter("embedding IS NOT NULL")
    blocks = max(1, -(-asked.count() // block))
    pool = vectors.select(F.col("embedding").cast("array<double>").alias("embedding"))
    out = None
    for number in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number).collect()
        found = _counts(pool, rows, least)
        out = found if out is None else out.unionByName(found)
    return out.groupBy("query_id").agg(F.sum("n").alias("n"))


def _counts(pool: DataFrame, rows: list, least: float) -> DataFrame:
    sent = pool.sparkSession.sparkContext.broadcast((np.array([r["query_id"] for r in rows], np.int64), [list(r["embedding"]) for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, values = sent.value
        counts = np.zeros(len(names), np.int64)
        asked = {n: [i for i, v in enumerate(values) if len(v) == n] for n in {len(v) for v in values}}
        for batch in batches:
            own = batch.column(0).to_pylist()
            for length, mine in asked.items():
                here = [v for v in own if v is not None and len(v) == length and None not in v]
                a = np.array([values[i] for i in mine], float)
                for at in range(0, len(here), 1024):
                    b = np.array(here[at : at + 1024], float)
                    size = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
                    sim = np.round(np.divide(a @ b.T, size, out=np.zeros_like(size), where=size > 0), 6)
                    counts[mine] += (sim >= least).sum(axis=1)
        some = counts > 0
        yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(counts[some])], ["query_id", "n"])

    return pool.mapInArrow(run, "query_id long, n long")
