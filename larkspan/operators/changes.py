"""Changes to tables as functions from old rows to new ones: the caller writes the result and swaps the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.operators.ranking import first_per, latest_per


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Rows of both; of a key the one with the greatest `at`, of equals the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest_per(both, keys, [at, "_new"]).drop("_new")


def upsert_add(old: DataFrame, new: DataFrame, keys: Sequence[str], amount: str, first: str) -> DataFrame:
    """Amounts of a key added up; the spelling that came first stays."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.groupBy(*keys).agg(F.min_by(first, F.struct("_new", first)).alias(first), F.sum(amount).alias(amount))


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows, and of the new ones the first of each key that is not there."""
    return old.unionByName(first_per(new.join(old.select(*keys), list(keys), "left_anti"), keys, new.columns))


def replace_by(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All new rows, and old ones of keys that the new rows don't have."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def delete_by(old: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows whose key is not among those that go; null keys stay."""
    return old.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def cascade(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each (table, column of the key) without the rows of the keys that go."""
    return {name: df.join(gone.select(F.col(key).alias(column)).distinct(), column, "left_anti") for name, (df, column) in tables.items()}


def soft_delete(df: DataFrame, which: Column, column: str, at: Column) -> DataFrame:
    """Marks rows as gone at a time; those marked before keep their time."""
    return df.withColumn(column, F.when(which & F.col(column).isNull(), at).otherwise(F.col(column)))


def purge(df: DataFrame, at: str, now: int, age: int) -> DataFrame:
    return df.filter(F.col(at) >= F.lit(now - age))


def capture(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, action, before, after) of rows that differ between two states: insert, update or delete, as JSON."""
    values = [c for c in before.columns if c not in keys]
    old = before.select(*keys, F.to_json(F.struct(*values), {"ignoreNullFields": "false"}).alias("before"))
    new = after.select(*keys, F.to_json(F.struct(*values), {"ignoreNullFields": "false"}).alias("after"))
    both = old.join(new, list(keys), "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))
    action = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
    return both.select(*keys, action.alias("action"), "before", "after")
