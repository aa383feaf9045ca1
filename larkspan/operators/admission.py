"""Admission of invocations under several limits at once: what each would have met, in order of time.

An invocation is admitted if none of the limits on it is reached; only then does it count, in all of them. What counts
depends on earlier decisions, across keys that don't contain one another, so no key divides the work. Bounds do:

1. Were all admitted, the numbers an invocation meets would be at least what it really meets. Where even these reach no
   limit, it is admitted for certain. They are sums over time, by the slices of `running`.
2. Only the others are contested, and only under the rules whose bound is reached. What they meet of the certain ones is
   a sum again.
3. Contested invocations that may meet each other, in time and under a rule whose bound is reached, make a component. In
   each, and nowhere else, decisions are taken one after the other. What is linked are stretches of a rule and key, by the
   invocations that are in several: far fewer than invocations.

Joins by the number of a row are merged: written, numbers take so little that a planner would send millions of them to
every task.

So a limit over all that isn't reached joins nothing, and a rule that is reached now and then joins only what happens at
such times. A limit over all that is reached without end makes one component of all contested ones, whose decisions do
depend on one another; they stream through a task that holds what runs at a time.
"""

from __future__ import annotations

import heapq
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.operators.links import linked
from larkspan.operators.stretches import running, slice_width, stretched
from larkspan.tables import materialize

ACCEPTED, CONCURRENCY, RATE = "accepted", "concurrency_exceeded", "rate_exceeded"
_NEVER = (1 << 63) - 1


@dataclass(frozen=True)
class Rule:
    """At most `limit` at once for each value of the columns `by`, or at most `limit` admitted in `window_ms`."""

    by: tuple[str, ...]
    limit: int
    window_ms: int | None = None

    def __post_init__(self):
        for value in (self.limit, 1 if self.window_ms is None else self.window_ms):
            if not isinstance(value, int) or isinstance(value, bool) or value <= 0:
                raise ValueError("invalid_concurrency_limits" if self.window_ms is None else "invalid_rate_limits")


#: What the four limits are counted by; a workspace is one of its tenant.
DIMENSIONS = {"global": (), "tenant": ("tenant_id",), "workspace": ("tenant_id", "workspace_id"), "principal": ("principal_id",)}


def four_limits(concurrency: dict[str, int], rates: dict[str, int] | None = None, window_ms: int | None = None) -> list[Rule]:
    """Rules of limits named as in DIMENSIONS, all of which are needed."""
    if set(concurrency) != set(DIMENSIONS):
        raise ValueError("invalid_concurrency_limits")
    if rates is not None and (set(rates) != set(DIMENSIONS) or window_ms is None):
        raise ValueError("invalid_rate_limits")
    at_once = [Rule(by, concurrency[name]) for name, by in DIMENSIONS.items()]
    return at_once + [Rule(by, rates[name], window_ms) for name, by in DIMENSIONS.items()] if rates else at_once


class Replay:
    """Decisions one after the other, given what each invocation meets of those that are admitted for certain."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.ends: dict[tuple, list[int]] = defaultdict(list)
        self.times: dict[tuple, deque] = defaultdict(deque)

    def decide(self, at: int, end: int, keys: list[str], met: list[int | None]) -> str:
        """met: for each rule the certain ones that count, or None if it can't be reached."""
        for rates in (False, True):
            for number, (rule, key, certain) in enumerate(zip(self.rules, keys, met, strict=True)):
                if certain is not None and (rule.window_ms is not None) == rates and certain + self._counted(number, key, at) >= rule.limit:
                    return RATE if rates else CONCURRENCY
        for number, (rule, key) in enumerate(zip(self.rules, keys, strict=True)):
            self._counted(number, key, at)
            if rule.window_ms is not None:
                self.times[number, key].append(at)
            elif end > at:
                heapq.heappush(self.ends[number, key], end)
        return ACCEPTED

    def _counted(self, number: int, key: str, at: int) -> int:
        window = self.rules[number].window_ms
        if window is None:
            held = self.ends[number, key]
            while held and held[0] <= at:
                heapq.heappop(held)
            return len(held)
        times = self.times[number, key]
        while times and times[0] <= at - window:
            times.popleft()
        return len(times)


def _keyed(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """(row, id, at, rule, key, until) for each row and rule: it counts there from `at` until before `until`."""
    until = [F.col("end") if r.window_ms is None else F.col("at") + F.lit(r.window_ms) for r in rules]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col("keys")[n].alias("key"), u.alias("until")) for n, u in enumerate(until)]))
    return rows.select("row", "id", "at", each.alias("r")).select("row", "id", "at", "r.rule", "r.key", "r.until")


def _met(counting: DataFrame, asking: DataFrame, width: int) -> DataFrame:
    """(row, rule, met): how many of `counting` came before each of `asking`, under its rule and key, and still count.

    Both have (row, id, at, rule, key); what ends at a time has ended for all that begin then.
    """
    counts = counting.filter(F.col("until") > F.col("at"))
    none, edge = F.lit(None).cast("long"), "asks"
    starts = counts.select("rule", "key", "at", F.lit(1).alias("kind"), "id", "row", F.lit(1).alias("step"), F.lit(False).alias(edge))
    ends = counts.select("rule", "key", F.col("until").alias("at"), F.lit(0).alias("kind"), none.alias("id"), none.alias("row"), F.lit(-1).alias("step"), F.lit(False).alias(edge))
    # An asking row comes just before its own start.
    asks = asking.select("rule", "key", "at", F.lit(1).alias("kind"), "id", "row", F.lit(0).alias("step"), F.lit(True).alias(edge))
    edges = starts.unionByName(ends.filter(F.col("at") < _NEVER)).unionByName(asks)
    sums = running(edges, ["rule", "key"], "at", ["kind", "id", "row", "step"], F.col("step"), "sum", "met", width)
    return sums.filter(edge).select("row", "rule", "met")


def admit(events: DataFrame, rules: list[Rule], at: str = "at", end: str | None = "end", ident: str = "event_id", rows_in_slice: int = 50_000) -> DataFrame:
    """(ident, decision): accepted, concurrency_exceeded or, if no limit on what runs at once is reached, rate_exceeded.

    events: the time and the end of each invocation in whole milliseconds, its id and the columns that rules count by. Order
    is by time, then id. One that ends at a time no longer counts for one that begins then; an end before the beginning is
    one at the beginning; a null end is none. Within a window of w, those of the last w milliseconds count, the edge not.

    Defined results: rows without a time have no decision (null) and count nowhere; null columns to count by are a value of
    their own; rows that repeat an id are invocations of their own, in any order; other columns are not read.
    """
    key = lambda rule: F.to_json(F.array(*[F.col(c).cast("string") for c in rule.by])) if rule.by else F.lit("[]")
    begun, over = F.col(at).cast("long"), F.col(end).cast("long") if end else F.lit(None).cast("long")
    plain = events.select(F.col(ident).cast("long").alias("id"), begun.alias("at"), F.greatest(begun, F.coalesce(over, F.lit(_NEVER))).alias("end"), F.array(*map(key, rules)).alias("keys"))
    # Rows are numbered once, so that a task that runs again numbers them alike.
    every = materialize(plain.withColumn("row", F.monotonically_increasing_id()), "invocations")
    rows = every.filter("at IS NOT NULL")
    width = slice_width(rows, "at", rows_in_slice)
    limits = F.create_map(*[x for n, r in enumerate(rules) for x in (F.lit(n), F.lit(r.limit))])
    # Keys of one hash only raise a bound.
    keyed = _keyed(rows, rules).withColumn("key", F.xxhash64("key"))
    bound = materialize(_met(keyed, keyed, width).filter(F.col("met") >= limits[F.col("rule")]).select("row", "rule"), "bounds")
    contested = materialize(rows.join(bound.select("row").distinct().hint("merge"), "row", "left_semi"), "contested")
    decided = _decided(rows.join(contested.hint("merge"), "row", "left_anti"), contested, bound, rules, width)
    known = F.when(F.col("at").isNotNull(), F.coalesce("decision", F.lit(ACCEPTED)))
    return every.join(decided.hint("merge"), "row", "left").select(F.col("id").alias(ident), known.alias("decision"))


def _decided(certain: DataFrame, contested: DataFrame, bound: DataFrame, rules: list[Rule], width: int) -> DataFrame:
    """(row, decision) of contested rows."""
    own = _keyed(contested, rules)
    asking = own.join(bound.hint("merge"), ["row", "rule"])
    places = asking.select("rule", "key").distinct()
    met = _met(_keyed(certain, rules).join(places, ["rule", "key"], "left_semi"), asking, width)
    numbers = F.map_from_entries(F.collect_list(F.struct("rule", "met")))
    rows = contested.join(met.groupBy("row").agg(numbers.alias("m")).hint("merge"), "row").withColumn("met", F.array(*[F.col("m")[n] for n in range(len(rules))]))
    # Members of a stretch of a rule and key may meet. Stretches of one hash only join components.
    members = stretched(own.join(places, ["rule", "key"], "left_semi"), ["rule", "key"], "at", ["id", "row"], F.col("until"), "begun", width)
    in_stretch = F.array_sort(F.collect_set(F.xxhash64("rule", "key", "begun"))).alias("in")
    within = materialize(members.groupBy("row").agg(in_stretch).select("row", F.col("in")[0].alias("node"), F.slice("in", 2, len(rules)).alias("others")), "stretches")
    component = linked(within.select(F.col("node").alias("a"), F.explode("others").alias("b")))
    named = within.drop("others").join(component, "node", "left").select("row", F.coalesce("smallest", "node").alias("component"))
    grouped = rows.join(named.hint("merge"), "row")
    ordered = grouped.select("component", "at", "end", "id", "row", "keys", "met").repartition("component").sortWithinPartitions("component", "at", "id", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, replay = None, None
        for batch in batches:
            out = []
            for group, at, end, keys, met in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 5, 6)), strict=True):
                if replay is None or group != now:
                    now, replay = group, Replay(rules)
                out.append(replay.decide(at, end, keys, met))
            yield pa.RecordBatch.from_arrays([batch.column(4), pa.array(out, pa.string())], ["row", "decision"])

    return ordered.mapInArrow(run, "row long, decision string")

