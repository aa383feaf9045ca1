from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from larkspan.operators import sketches

SCHEMA = "ts timestamp, kind string, user long, value double"


def test_sketches_of_days_say_what_one_of_all_says(spark):
    rng = random.Random(1)
    rows = [(datetime(2024, 1, 1) + timedelta(days=rng.randrange(10)), f"k{rng.randrange(2)}", rng.randrange(4000), rng.expovariate(0.02)) for _ in range(30_000)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    days = sketches.daily(frame, ["kind"], "ts", "user", "value")
    assert days.count() == 20
    got = {r.kind: r for r in sketches.estimates(sketches.merged(days, ["kind"]), ["kind"]).collect()}
    for kind in ("k0", "k1"):
        own = [r for r in rows if r[1] == kind]
        values = sorted(r[3] for r in own)
        assert got[kind].n == len(own)
        assert got[kind].distinct_about == pytest.approx(len({r[2] for r in own}), rel=0.06)
        for share, about in ((0.5, got[kind].p50), (0.95, got[kind].p95)):
            assert values[int((share - 0.04) * len(own))] <= about <= values[min(len(own) - 1, int((share + 0.04) * len(own)))]
    every = sketches.estimates(sketches.merged(sketches.merged(days, ["kind"]), []), []).first()
    assert every.n == 30_000 and every.distinct_about == pytest.approx(len({r[2] for r in rows}), rel=0.06)


def test_nulls_and_empty_tables(spark):
    frame = spark.createDataFrame([(None, "k", None, None), (datetime(2024, 1, 1), "k", 5, None), (datetime(2024, 1, 1), None, 5, 2.0)], SCHEMA)
    days = sketches.daily(frame, ["kind"], "ts", "user", "value")
    got = {(r.kind): (r.n, r.distinct_about, r.p50) for r in sketches.estimates(sketches.merged(days, ["kind"]), ["kind"]).collect()}
    assert got == {"k": (2, 1, None), None: (1, 1, 2.0)}
    assert sketches.daily(frame.limit(0), ["kind"], "ts", "user", "value").collect() == []
