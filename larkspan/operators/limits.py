"""Limiters and breakers over event tables: what each event would have met, in order of time.

Where a decision refers to earlier ones, which window functions can't, events run through a small state machine: not all of
a key, but those of a stretch, after which the machine is as new. Rows stream in order of time, in Arrow batches, and the
state is a few numbers, whatever the number of events.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspan.operators.admission import Rule, admit
from larkspan.operators.stretches import slice_width, stretched


def replay(events: DataFrame, key: str, at: str, ident: str, machine: Callable[[], Callable[[float, object], tuple]], value: str | None, schema: str, names: list[str], rests_ms: int | None = None) -> DataFrame:
    """(ident, *names) from a machine fed with (time in whole ms, value) in order of time, then ident: one for each key or, if
    a machine is as new after `rests_ms` without an event, for each stretch of a key between such rests."""
    columns = events.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.col(at).cast("long").alias("t"), F.col(ident).cast("long").alias("i"), (F.col(value) if value else F.lit(None)).cast("string").alias("v"))
    if rests_ms is None:
        columns = columns.withColumn("s", F.lit(0).cast("long"))
    else:
        columns = stretched(columns, ["k"], "t", ["i"], F.col("t") + F.lit(rests_ms), "s", slice_width(columns, "t"))
    ordered = columns.select("k", "s", "t", "i", "v").repartition("k", "s").sortWithinPartitions("k", "s", "t", "i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = object(), None
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for k, s, t, v in zip(*(batch.column(n).to_pylist() for n in (0, 1, 2, 4)), strict=True):
                if (k, s) != now:
                    now, step = (k, s), machine()
                for column, x in zip(out, step(t, v), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(3), *map(pa.array, out)], [ident, *names])

    return ordered.mapInArrow(run, f"{ident} long, {schema}")


def token_bucket(events: DataFrame, key: str, at: str, ident: str, capacity: float, per_minute: float) -> DataFrame:
    """(ident, allowed, retry_ms): a bucket of `capacity` tokens that refills at a rate; each event takes one. It is full
    again after as long a rest as it takes to fill from empty."""
    rate = per_minute / 60

    def machine():
        tokens, last = capacity, None

        def step(t, _):
            nonlocal tokens, last
            tokens = min(capacity, tokens + (t - (t if last is None else last)) / 1000 * rate)
            last = t
            if tokens >= 1:
                tokens -= 1
                return True, 0
            return False, ceil((1 - tokens) / rate * 1000)

        return step

    return replay(events, key, at, ident, machine, None, "allowed boolean, retry_ms long", ["allowed", "retry_ms"], ceil(capacity / rate * 1000) + 1)


def sliding_limit(events: DataFrame, key: str, at: str, ident: str, limit: int, window_ms: int) -> DataFrame:
    """(ident, allowed): at most `limit` accepted events within a window; what is refused does not count."""
    decided = admit(events, [Rule((key,), limit, window_ms)], at, None, ident)
    return decided.select(ident, (F.col("decision") == "accepted").alias("allowed"))


def circuit_breaker(events: DataFrame, key: str, at: str, ident: str, ok: str, window: int = 5, threshold: float = 0.4, backoff_ms: int = 120_000) -> DataFrame:
    """(ident, decision): 'called', or 'backoff' for an event within the backoff after a window of too many failures;
    such events are not recorded."""

    def machine():
        recent: deque = deque(maxlen=window)
        until = float("-inf")

        def step(t, v):
            nonlocal until
            if t < until:
                return ("backoff",)
            recent.append(v in ("1", "true", "ok"))
            if len(recent) == window and sum(recent) / window <= threshold:
                until = t + backoff_ms
            return ("called",)

        return step

    return replay(events, key, at, ident, machine, ok, "decision string", ["decision"])


def offered_load(events: DataFrame, key: str, at: str, window_ms: int) -> DataFrame:
    """Adds offered: events of the key in the window that ends with this one, itself not counted."""
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-(window_ms - 1), 0)
    return events.withColumn("offered", F.count("*").over(w) - 1)


def health(attempts: DataFrame, key: str, order: list[str], ok: str, last: int = 5) -> DataFrame:
    """Per key of the last attempts: how many, successes, failures, rate (null without any)."""
    recent = attempts.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order]))).filter(F.col("_n") <= last)
    good = F.count_if(F.col(ok))
    return recent.groupBy(key).agg(F.count("*").alias("recent"), good.alias("successes"), (F.count("*") - good).alias("failures"), F.try_divide(good, F.count("*")).alias("rate"))


def usage(events: DataFrame, keys: list[str], ok: str, most: int = 10_000, order: str = "event_id") -> DataFrame:
    """Calls and errors of each key combination, of each prefix of it and in all; combinations first seen after the first
    `most` count in the sums but have no row of their own."""
    # A limit behind an order keeps `most` rows a task before anything moves.
    early = events.groupBy(*keys).agg(F.min(order).alias("_first")).orderBy("_first", *keys).limit(most).select(*keys)
    sums = events.rollup(*keys).agg(F.count("*").alias("calls"), F.count_if(~F.col(ok)).alias("errors"), F.grouping_id().alias("level"))
    whole = sums.filter("level = 0").join(early, keys, "left_semi")
    return sums.filter("level <> 0").unionByName(whole)


def concurrency(events: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Per key the most that ran at once; one that ends when another starts is over by then."""
    edges = events.select(key, F.col(start).alias("_t"), F.lit(1).alias("_d")).unionByName(events.select(key, F.col(end).alias("_t"), F.lit(-1).alias("_d")))
    running = F.sum("_d").over(Window.partitionBy(key).orderBy("_t", "_d").rowsBetween(Window.unboundedPreceding, 0))
    return edges.withColumn("_r", running).groupBy(key).agg(F.max("_r").alias("most_at_once"))
