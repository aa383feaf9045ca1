"""Admission under several limits against a replay of all invocations, one after the other."""

from __future__ import annotations

import random

import pytest

from larkspan.operators import admission
from larkspan.operators.admission import Rule, admit, four_limits
from larkspan.operators.links import linked
from larkspan.operators.stretches import running
from pyspark.sql import functions as F

SCHEMA = "event_id long, at long, end long, tenant_id string, workspace_id string, principal_id string, row string, key string"


def plain(rows, rules):
    """{(id, decision)} by looking at all that was admitted before."""
    admitted, out = [], []
    names = SCHEMA.replace(",", "").split()[::2]
    for row in sorted((dict(zip(names, r, strict=False)) for r in rows if r[1] is not None), key=lambda r: (r["at"], r["event_id"])):
        verdict = "accepted"
        for rates in (False, True):
            for rule in rules:
                same = [a for a in admitted if all(a[c] == row[c] for c in rule.by)]
                if (rule.window_ms is not None) != rates:
                    continue
                n = sum(a["at"] > row["at"] - rule.window_ms for a in same) if rates else sum(a["end"] is None or a["end"] > row["at"] for a in same)
                if n >= rule.limit and verdict == "accepted":
                    verdict = "rate_exceeded" if rates else "concurrency_exceeded"
        out.append((row["event_id"], verdict))
        if verdict == "accepted":
            admitted.append(row | {"end": row["end"] if row["end"] is None else max(row["end"], row["at"])})
    return sorted(out + [(r[0], None) for r in rows if r[1] is None], key=repr)


def made(rng, count, span, longest):
    rows = []
    for i in range(count):
        at = rng.randrange(span)
        rows.append((i, at, at + rng.randrange(longest), f"t{rng.randrange(3)}", f"w{rng.randrange(3)}", f"p{min(rng.randrange(8), rng.randrange(8))}", "r", "k"))
    return rows


TIGHT = four_limits({"global": 9, "tenant": 5, "workspace": 3, "principal": 2}, {"global": 40, "tenant": 20, "workspace": 9, "principal": 6}, 500)
LOOSE = four_limits({"global": 1000, "tenant": 400, "workspace": 3, "principal": 2}, {"global": 9000, "tenant": 9000, "workspace": 9000, "principal": 5}, 300)


@pytest.mark.parametrize(("rules", "seed", "slice_rows"), [(TIGHT, 1, 50_000), (TIGHT, 2, 7), (LOOSE, 3, 7), (LOOSE[:4], 4, 20), ([Rule((), 3, 100)], 5, 10), ([Rule(("principal_id",), 1)], 6, 10)])
def test_decisions_equal_a_replay_of_all(spark, seed, rules, slice_rows):
    rows = made(random.Random(seed), 400, 12_000, 400)
    got = admit(spark.createDataFrame(rows, SCHEMA).repartition(5), rules, rows_in_slice=slice_rows)
    found = sorted(map(tuple, got.collect()), key=repr)
    assert found == plain(rows, rules)
    assert {d for _, d in found} > {"accepted"}


def test_edges_of_time_nulls_and_repeated_rows(spark):
    rows = [(1, 0, 10, "t", "w", "p"), (2, 10, 10, "t", "w", "p"), (3, 10, 20, "t", "w", "p"), (4, 15, None, "t", "w", "p"), (5, 20, 5, "t", "w", "p"), (6, 21, 30, "t", "w", "p"), (7, 22, 30, "t", "w", None), (8, 23, 30, "t", "w", None), (9, None, 4, "t", "w", "p"), (10, 40, 50, None, None, "q"), (10, 40, 50, None, None, "q")]
    rows = [(*r, "r", "k") for r in rows]
    rules = [Rule(("principal_id",), 1)]
    got = sorted(map(tuple, admit(spark.createDataFrame(rows, SCHEMA), rules).collect()), key=repr)
    assert got == plain(rows, rules)
    assert admit(spark.createDataFrame([], SCHEMA), TIGHT).collect() == []


def test_a_limit_on_all_that_is_not_reached_joins_nothing(spark, monkeypatch):
    """The components that are replayed hold the invocations of a principal, not those of a tenant or of all."""
    seen = []
    own = admission._decided
    monkeypatch.setattr(admission, "_decided", lambda certain, contested, *rest: seen.append((certain.count(), contested.count())) or own(certain, contested, *rest))
    rows = made(random.Random(9), 600, 100_000, 300)
    rules = four_limits({"global": 100, "tenant": 100, "workspace": 100, "principal": 1})
    got = admit(spark.createDataFrame(rows, SCHEMA), rules)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, rules)
    (certain, contested), = seen
    assert certain + contested == 600 and 0 < contested < 300
    text = got._jdf.queryExecution().toString()
    assert "SinglePartition" not in text and "BroadcastNestedLoop" not in text and "CartesianProduct" not in text


def test_limits_are_checked():
    with pytest.raises(ValueError, match="invalid_concurrency_limits"):
        four_limits({"global": 1, "tenant": 1, "workspace": 1})
    with pytest.raises(ValueError, match="invalid_concurrency_limits"):
        four_limits({"global": 0, "tenant": 1, "workspace": 1, "principal": 1})
    with pytest.raises(ValueError, match="invalid_rate_limits"):
        four_limits(dict.fromkeys(admission.DIMENSIONS, 1), dict.fromkeys(admission.DIMENSIONS, 1.5), 10)
    with pytest.raises(ValueError, match="invalid_rate_limits"):
        four_limits(dict.fromkeys(admission.DIMENSIONS, 1), dict.fromkeys(admission.DIMENSIONS, 1))


def test_links(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(25)] + [(500, 500 + i) for i in range(50)] + [(7, 7), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {tuple(r) for r in linked(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, root(x)) for x in parent if root(x) != x}
    assert linked(spark.createDataFrame([], "a long, b long")).collect() == []


def test_running_sums_do_not_depend_on_slices(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(f"k{rng.randrange(2)}", rng.randrange(-50, 50), i, rng.randrange(10)) for i in range(200)], "k string, at long, id long, v long")
    for how, own in (("sum", True), ("max", False)):
        results = [sorted(map(tuple, running(rows, ["k"], "at", ["id"], F.col("v"), how, "n", width, own).select("id", "n").collect())) for width in (1, 9, 1000)]
        assert results[0] == results[1] == results[2]


def test_numbers_of_rows_are_not_sent_to_every_task(spark):
    """Written, a column of row numbers is a small part of what it takes in memory: a planner takes it for a small table."""
    events = spark.range(3000).selectExpr("id AS event_id", "id * 10 AS ms", "CAST(id % 3 AS STRING) AS k")
    decided = admission.admit(events, [admission.Rule(("k",), 5, 1000)], "ms", None)
    plan = decided._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [row" in plan and "BroadcastHashJoin [row" not in plan
    assert 0 < decided.filter("decision = 'accepted'").count() < 3000
