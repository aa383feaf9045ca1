"""Rank assignment, top-k, first and last rows of a key, with explicit total orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _columns(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def with_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """The place, from 1, of each row among those of its keys; `order` should be total."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*_columns(order))))


def top_k_per(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int, name: str = "rank", where: Column | None = None) -> DataFrame:
    """The first k rows of each key. `where` comes before the ranking. Catalyst limits each group in every task before
    the shuffle (WindowGroupLimit), so that a hot key sends k rows a task."""
    return with_rank(df.filter(where) if where is not None else df, keys, order, name).filter(F.col(name) <= k)


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key."""
    return top_k_per(df, keys, order, 1, "_rank").drop("_rank")


def latest_per(df: DataFrame, keys: Sequence[str], at: Sequence[str]) -> DataFrame:
    """The newest row of each key: the greatest of the columns `at`, one after the other."""
    return first_per(df, keys, [F.col(c).desc() for c in at])


def first_non_empty(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """Of each key the rows with its smallest ordinal: the first source that has any."""
    low = F.min(ordinal).over(Window.partitionBy(*keys))
    return df.withColumn("_low", low).filter(F.col(ordinal) == F.col("_low")).drop("_low")


def diverse(df: DataFrame, keys: Sequence[str], source: str, rank: str, most: int = 3) -> DataFrame:
    """The first rows by rank, at most `most`, where from the third on no source comes twice."""
    seen = F.row_number().over(Window.partitionBy(*keys, source).orderBy(rank))
    return df.filter(F.col(rank) <= most).withColumn("_seen", seen).filter(~((F.col(rank) > 2) & (F.col("_seen") > 1))).drop("_seen")
