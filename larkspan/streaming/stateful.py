"""Limiters and breakers as stateful streams: the machines of `larkspan.operators.limits` with their state kept by Spark."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def token_bucket(events: DataFrame, key: str, capacity: float, per_minute: float) -> DataFrame:
    """(key, event_id, allowed, retry_ms) of a stream (key, event_id, ms). Events of a batch are taken in order of time."""
    rate = per_minute / 60

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (float(capacity), None)
        rows = pd.concat(list(batches)).sort_values(["ms", "event_id"])
        allowed, retry = [], []
        for now in rows["ms"].tolist():
            tokens = min(capacity, tokens + (now - (now if last is None else last)) / 1000 * rate)
            last = now
            allowed.append(tokens >= 1)
            retry.append(0 if tokens >= 1 else ceil((1 - tokens) / rate * 1000))
            tokens -= tokens >= 1
        state.update((float(tokens), float(last)))
        yield pd.DataFrame({"key": [name[0]] * len(rows), "event_id": rows["event_id"].tolist(), "allowed": allowed, "retry_ms": retry})

    named = events.select(F.col(key).cast("string").alias("key"), "event_id", F.col("ms").cast("double").alias("ms"))
    return named.groupBy("key").applyInPandasWithState(run, "key string, event_id long, allowed boolean, retry_ms long", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def sliding_limit(events: DataFrame, key: str, limit: int, window_ms: int) -> DataFrame:
    """(key, event_id, allowed): at most `limit` accepted events within the window; the state holds those times."""

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        accepted = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ms", "event_id"])
        allowed = []
        for now in rows["ms"].tolist():
            accepted = [t for t in accepted if t > now - window_ms]
            allowed.append(len(accepted) < limit)
            if allowed[-1]:
                accepted.append(now)
        state.update((accepted,))
        yield pd.DataFrame({"key": [name[0]] * len(rows), "event_id": rows["event_id"].tolist(), "allowed": allowed})

    named = events.select(F.col(key).cast("string").alias("key"), "event_id", F.col("ms").cast("double").alias("ms"))
    return named.groupBy("key").applyInPandasWithState(run, "key string, event_id long, allowed boolean", "accepted array<double>", "append", GroupStateTimeout.NoTimeout)
