"""Exact top-k inner products by a three-phase uniform threshold.

A score is the sum of the inner products over `segments` stretches of the components, the local scores. Phase one: where
candidates lie, each query's local lists give up their best k entries of every segment; these vectors' whole scores are
gathered, and the k-th best of them over all partitions is a safe cutoff: k vectors reach it. The cutoffs are broadcast,
a block of queries at a time. Phase two: a vector whose score reaches the cutoff has some local score of at least
cutoff / segments; all entries that reach this uniform threshold are collected, no others can matter. Phase three: for
these the remaining local scores are looked up, and what reaches the cutoff is ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspan.llm.common import materialize, table

#: Sums of products below this are exact in floating point.
_EXACT = float(1 << 53)
_ROWS = 1024


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): integer components floor(scale * x) of the vectors without null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    whole = source.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(F.forall("v", finite))
    return whole.select("id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("v"))


class Block:
    """Queries of one block by the length of their vectors."""

    def __init__(self, rows: list[tuple[int, list[float]]]):
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in sorted({len(v) for _, v in rows}):
            own = [(i, v) for i, v in rows if len(v) == length]
            self.by_length[length] = (np.array([i for i, _ in own], np.int64), np.array([v for _, v in own], float).reshape(len(own), length))


def _fits(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether inner products of rows over their whole length, and so all sums of parts of them, are exact as floats."""
    return a.shape[1] * (np.abs(a).max(initial=0) * np.abs(b).max(initial=0)) < _EXACT


def _product(a: np.ndarray, b: np.ndarray, fits: bool) -> np.ndarray:
    """Inner products of rows, exact: by Python's integers where floating point would not be."""
    if fits:
        return a @ b.T
    exact = np.vectorize(int, otypes=[object])
    return exact(a) @ exact(b).T if a.size and b.size else np.zeros((len(a), len(b)))


def _grouped(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of at most _ROWS candidates of one vector length."""
    ids = batch.column(0).to_numpy()
    column = batch.column(1)
    lengths = column.value_lengths().to_numpy()
    for length in np.unique(lengths):
        which = np.flatnonzero(lengths == length)
        for i in range(0, len(which), _ROWS):
            part = which[i : i + _ROWS]
            flat = column.take(pa.array(part)).flatten().to_numpy()
            yield ids[part], flat.reshape(len(part), length)


def _segments(length: int, count: int) -> list[slice]:
    count = max(1, min(count, length))
    return [slice(length * i // count, length * (i + 1) // count) for i in range(count)]


def _best(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of each owner's k best, higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, owner))
    owner = owner[order]
    start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.empty(0, int)
    place = np.arange(len(owner)) - np.repeat(start, np.diff(np.r_[start, len(owner)]))
    return order[place < k]


def _scan(block: Block, k: int, segments: int, cutoffs: dict[int, float] | None):
    """Over candidates (id, v): rows (query_id, vec_id, score), at most k a query and task.

    Without cutoffs, phase one: the whole scores of the best k entries of each local list. With them, phases two and three.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def squeeze() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            q, v, s = (np.concatenate(x) for x in zip(*held, strict=True))
            keep = _best(q, s, v, k)
            return q[keep], v[keep], s[keep]

        for batch in batches:
            for ids, matrix in _grouped(batch):
                found = block.by_length.get(matrix.shape[1])
                if found is None:
                    continue
                for i in range(0, len(found[0]), _ROWS):
                    names, queries = found[0][i : i + _ROWS], found[1][i : i + _ROWS]
                    cuts = _segments(matrix.shape[1], segments)
                    fits = _fits(queries, matrix)
                    local = [_product(queries[:, c], matrix[:, c], fits) for c in cuts]
                    other = names[:, None] != ids[None, :]
                    if cutoffs is None:
                        taken = np.zeros(other.shape, bool)
                        for part in local:
                            if part.shape[1] > k + 1:
                                top = np.argpartition(-part.astype(float), k, axis=1)[:, : k + 1]
                                np.put_along_axis(taken, top, True, axis=1)
                            else:
                                taken[:] = True
                    else:
                        least = np.array([cutoffs.get(q, -np.inf) for q in names.tolist()])[:, None]
                        # A little below the threshold, so that rounding of the division costs nothing.
                        bar = least / len(cuts)
                        bar = bar - np.abs(bar) * 1e-9
                        taken = np.logical_or.reduce([part >= bar for part in local])
                    x, y = np.nonzero(taken & other)
                    score = sum(part[x, y] for part in local)
                    if cutoffs is not None:
                        good = score >= least[x, 0]
                        x, y, score = x[good], y[good], score[good]
                    held.append((names[x], ids[y], np.asarray(score, np.int64 if score.dtype != object else object)))
                    size += len(x)
                    if size > 100_000:
                        held[:] = [squeeze()]
                        size = 0
        if held:
            q, v, s = squeeze()
            s = np.array([max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in s], np.int64) if s.dtype == object else s
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], ["query_id", "vec_id", "score"])

    return run


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, segments: int = 4, block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest scores, ties to the smaller vec_id.

    Queries come to the driver and go to the executors in blocks of about `block` vectors, dealt by hash, one block after
    the other; candidates are read where they lie, once more for each block and phase, and never shuffled. What is
    shuffled is at most k rows for each query and task.

    Defined results: vectors that are null or hold null or non-finite components, and rows with a null id, take no part;
    vectors of different lengths have no score; a query's own rows are those with its id; repeated rows are candidates
    of their own; repeated query rows are one query (of different vectors with one id, the least); other columns are
    not read; no candidates give no rows. Scores beyond 64 bits are set to the nearest 64-bit integer.
    """
    asked = materialize(quantised(queries, id_col, vector_col, scale).groupBy("id").agg(F.min("v").alias("v")), "queries")
    pool = quantised(candidates, id_col, vector_col, scale)
    schema = "query_id long, vec_id long, score long"
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    blocks = max(1, -(-asked.count() // block))
    out = None
    for number in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number) if blocks > 1 else asked
        shared = Block([(r.id, list(r.v)) for r in own.collect()])
        sent = queries.sparkSession.sparkContext.broadcast(shared)
        first = ranked(pool.mapInArrow(_late(sent, k, segments, None), schema)).filter(F.col("rank") == k)
        cutoffs = {r.query_id: r.score for r in first.select("query_id", "score").collect()}
        rows = ranked(pool.mapInArrow(_late(sent, k, segments, cutoffs), schema))
        rows = rows if blocks == 1 else materialize(rows, "top")
        out = rows if out is None else out.unionAll(rows)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _late(sent, k: int, segments: int, cutoffs: dict[int, float] | None):
    """_scan over a broadcast block that is opened on the executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _scan(sent.value, k, segments, cutoffs)(batches)

    return run


def op1_exact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors.filter(F.col("vec_id") % 100 == 0), vectors)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
