"""Running sums and maxima over time, and stretches of events, without a task that holds all rows of a key.

Time is cut into slices. What the slices before sum up to is a row for each key and slice, added to what a window finds
within the slice; so a key with a third of all rows, or a single key for all, is spread over as many tasks as there are
slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def slice_width(rows: DataFrame, at: str, rows_in_slice: int = 50_000) -> int:
    """The width, in the units of `at`, of slices that have about so many rows each when time is even."""
    low, high, count = rows.agg(F.min(at), F.max(at), F.count(at)).first()
    return 1 if not count else max(1, (high - low + 1) * rows_in_slice // count)


def running(rows: DataFrame, keys: list[str], at: str, order: list[str], value: Column, how: str, name: str, width: int, own: bool = True) -> DataFrame:
    """Adds `name`: the sum or max (`how`) of `value` over the rows of the same keys up to this one in the order of `at`,
    then `order`; without `own`, over those before it. `at` is a whole number; keys are not null."""
    fold = {"sum": F.sum, "max": F.max}[how]
    sliced = rows.withColumn("_slice", F.floor(F.col(at) / F.lit(width)).cast("long")).withColumn("_value", value)
    sums = sliced.groupBy(*keys, "_slice").agg(fold("_value").alias("_sum"))
    before = sums.withColumn("_before", fold("_sum").over(Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))).drop("_sum")
    within = Window.partitionBy(*keys, "_slice").orderBy(at, *order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    # The join is by the keys that the window needs together, so both share one exchange of the rows.
    met = sliced.join(before, [*keys, "_slice"]).withColumn("_own", fold("_value").over(within))
    total = F.coalesce("_own", F.lit(0)) + F.coalesce("_before", F.lit(0)) if how == "sum" else F.greatest("_own", "_before")
    return met.withColumn(name, total).drop("_slice", "_value", "_before", "_own")


def stretched(rows: DataFrame, keys: list[str], at: str, order: list[str], until: Column, name: str, width: int) -> DataFrame:
    """Adds `name`, the time at which the row's stretch began. A row begins a stretch if all rows of its keys before it have
    passed: `until` says for each up to when it may matter to later ones."""
    reach = running(rows, keys, at, order, until, "max", "_reach", width, own=False)
    begun = F.when(F.col("_reach").isNull() | (F.col(at) >= F.col("_reach")), F.col(at))
    return running(reach, keys, at, order, begun, "max", name, width).drop("_reach")
