"""Whitening of embeddings by principal components, from a covariance taken in two passes.

Vectors become integers. Pass one sums the distinct vectors exactly, which gives the mean as a fraction S / n. Pass two
sums the outer products of n * x - S, whole numbers that are centred before they are multiplied, by NumPy's matrix
product; treeAggregate merges the sums of tasks in both passes. The driver holds one d x d matrix, solves it by LAPACK's
symmetric `eigh` and broadcasts the projection, `count` x d numbers. A third pass measures the covariance of the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import discard, materialize, table

#: Sums and products of integers stay below this, else Python's integers are used.
_LONG = 1 << 62
_ROWS = 8192
OUTPUT = "id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int, shift: int) -> DataFrame:
    """(id, x): floor(scale * c) + shift of vectors without null or non-finite entries; what no long holds is set to 2^62."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    bounded = lambda c: F.greatest(F.least(c * F.lit(float(scale)), F.lit(2.0**62)), F.lit(-(2.0**62)))
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    whole = source.filter(F.col("v").isNotNull()).filter((F.size("v") > 0) & F.forall("v", finite))
    return whole.select("id", F.transform("v", lambda c: F.floor(bounded(c)).cast("long") + F.lit(shift).cast("long")).alias("x"))


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix of integers) of at most _ROWS vectors of one length."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for length in np.unique(lengths):
        which = np.flatnonzero(lengths == length)
        for i in range(0, len(which), _ROWS):
            part = which[i : i + _ROWS]
            yield part, column.take(pa.array(part)).flatten().to_numpy().reshape(len(part), length)


def exact_sums(x: np.ndarray) -> np.ndarray:
    """Sums of the columns as Python's integers."""
    if int(np.abs(x).max(initial=0)) * max(1, len(x)) < _LONG:
        return x.sum(axis=0).astype(object)
    return x.astype(object).sum(axis=0)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exact: as 64-bit integers where they fit, else as Python's."""
    if max(int(np.abs(x).max(initial=0)) * n, max(abs(int(s)) for s in sums)) < _LONG:
        return x * np.int64(n) - sums.astype(np.int64)
    return x.astype(object) * n - sums


def deviations(whole: np.ndarray) -> list[int]:
    """The exact sum of squares of each row."""
    if whole.dtype != object and int(np.abs(whole).max(initial=0)) ** 2 * whole.shape[1] < _LONG:
        return (whole * whole).sum(axis=1).tolist()
    return [sum(v * v for v in row) for row in whole.astype(object).tolist()]


def _tree(rows: DataFrame, column: str, part: Callable[[np.ndarray], object], add: Callable[[object, object], object]) -> dict[int, object]:
    """length -> the parts of all vectors of that length, added up. A task makes one small row; treeAggregate merges them."""
    import pickle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, object] = {}
        for batch in batches:
            for _, x in matrices(batch.column(0)):
                own = part(x)
                total[x.shape[1]] = add(total[x.shape[1]], own) if x.shape[1] in total else own
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["total"])

    def merge(a: dict, b: dict) -> dict:
        return {k: add(a[k], b[k]) if k in a and k in b else a.get(k, b.get(k)) for k in a.keys() | b.keys()}

    packed = rows.select(column).mapInArrow(run, "total binary").rdd
    return packed.treeAggregate({}, lambda a, row: merge(a, pickle.loads(bytes(row.total))), merge)


@dataclass
class Whitening:
    """What `fit` learns of vectors of one length: n and S, and unit eigenvectors in rows with their eigenvalues."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    #: Components whose eigenvalue isn't zero to working precision; the others can't be scaled.
    rank: int
    identity_error: float = 0.0

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n * x - S, whitened components) of rows; components beyond the rank are NaN."""
        whole = centred(x, self.n, self.sums)
        out = np.full((len(x), len(self.vectors)), np.nan)
        scale = 1 / np.sqrt(self.values[: self.rank])
        out[:, : self.rank] = (whole.astype(float) / self.n) @ self.vectors[: self.rank].T * scale
        return whole, out


def solve(n: int, sums: np.ndarray, products: np.ndarray, count: int) -> Whitening:
    """Components of the covariance, by falling eigenvalue; of either sign, that with a positive largest entry."""
    covariance = (products + products.T) / (2 * n)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:count].copy(), vectors[:, ::-1][:, :count].T.copy()
    largest = np.abs(vectors).argmax(axis=1)
    vectors *= np.sign(vectors[np.arange(len(vectors)), largest])[:, None]
    tiny = max(values[0], 0.0) * len(sums) * np.finfo(float).eps * 8
    return Whitening(n, sums, vectors, np.maximum(values, 0), float(np.trace(covariance)), int((values > tiny).sum()))


def _moments(y: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, sum of centred outer products)."""
    mean = y.mean(axis=0)
    y = y - mean
    return len(y), mean, y.T @ y


def _moments_added(a: tuple, b: tuple) -> tuple:
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def fit(distinct: DataFrame, column: str = "x", count: int = 16) -> dict[int, Whitening]:
    """length -> the whitening of the vectors of that length in `distinct`, each of which counts once."""
    spark = distinct.sparkSession.sparkContext
    first = _tree(distinct, column, lambda x: (len(x), exact_sums(x)), lambda a, b: (a[0] + b[0], a[1] + b[1]))
    if not first:
        return {}
    sent = spark.broadcast(first)

    def outer(x: np.ndarray) -> np.ndarray:
        n, sums = sent.value[x.shape[1]]
        y = centred(x, n, sums).astype(float) / n
        return y.T @ y

    second = _tree(distinct, column, outer, lambda a, b: a + b)
    models = {length: solve(n, sums, second[length], count) for length, (n, sums) in first.items()}
    fitted = spark.broadcast(models)

    def whitened(x: np.ndarray) -> tuple:
        model = fitted.value[x.shape[1]]
        return _moments(model.project(x)[1][:, : model.rank])

    third = _tree(distinct, column, whitened, _moments_added)
    for length, (n, _, products) in third.items():
        models[length].identity_error = float(np.abs(products / n - np.eye(len(products))).max(initial=0))
    return models


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shift: int = 1_000_000, count: int = 16) -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each vector and component.

    A vector counts once in the fit, however many rows repeat it, and every row is projected. Equal vectors are folded in
    each task before the one shuffle. What the driver holds and sends is bounded by the vectors' length d, not by their
    number: d^2 numbers, and `count` x d to project.

    Defined results: vectors that are null, empty or hold null or non-finite entries take no part; null and repeated ids
    keep their rows; other columns are not read; vectors of another length are whitened apart; with fewer entries than
    `count` there are as many components as entries; where an eigenvalue is zero to working precision (one vector, equal
    entries) `whitened` is null, and `explained` is 0 if all are; deviations of more than 38 digits are null; entries
    beyond 2^62 / scale are set to it; an empty table gives no rows.
    """
    rows = integers(vectors, id_col, vector_col, scale, shift)
    distinct = materialize(rows.select("x").distinct(), "distinct-vectors")
    models = fit(distinct, "x", count)
    discard(distinct)
    sent = vectors.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, x in matrices(batch.column(1)):
                model = sent.value[x.shape[1]]
                whole, scores = model.project(x)
                parts = scores.shape[1]
                exact = pa.array([v if v < 10**38 else None for v in deviations(whole)], pa.decimal128(38, 0))
                ids = np.repeat(places, parts)
                flat = scores.ravel()
                explained = np.tile(model.values / model.trace if model.trace > 0 else np.zeros(parts), len(x))
                again = pa.array(np.repeat(np.arange(len(x)), parts))
                columns = [batch.column(0).take(pa.array(ids)), pa.array(np.tile(np.arange(1, parts + 1, dtype=np.int32), len(x))), pa.array(np.full(len(flat), model.n, np.int64)), exact.take(again), pa.array(flat, mask=np.isnan(flat)), pa.array(explained), pa.array(np.full(len(flat), model.identity_error))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, OUTPUT).withColumnRenamed("id", id_col)


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """Deviations that no long holds, at some 10^8 distinct vectors of unit length, are null."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
