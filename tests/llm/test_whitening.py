from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest

from larkspan.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, id string, x string, component string, n string"


def plain(rows, count=16):
    """{(id, component): (n, deviation, whitened, explained)}, one list for each, by whole matrices."""
    good = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    out = defaultdict(list)
    for length in {len(x) for _, x in good}:
        own = [(i, x) for i, x in good if len(x) == length]
        fit = sorted({x for _, x in own})
        n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
        y = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in fit])
        values, vectors = np.linalg.eigh(y.T @ y / n)
        values, vectors = values[::-1], vectors[:, ::-1]
        for i, x in own:
            apart = [n * a - s for a, s in zip(x, sums, strict=True)]
            for c in range(min(count, length)):
                flat = values[c] <= 1e-9 * max(values[0], 1e-300)
                whitened = None if flat else abs(float(np.array(apart) / n @ vectors[:, c]) / math.sqrt(values[c]))
                out[i, c + 1].append((n, sum(a * a for a in apart), whitened, max(values[c], 0) / values.sum() if values.sum() > 0 else 0.0))
    return out


def held(rows, got):
    expected = plain(rows)
    found = defaultdict(list)
    for r in got:
        found[r.vec_id, r.component].append((r.n, int(r.deviation), r.whitened, r.explained))
        assert r.identity_error <= 1e-4
    assert found.keys() == expected.keys()
    for key, own in expected.items():
        order = lambda t: (t[0], t[1], abs(t[2] or 0))
        for a, b in zip(sorted(found[key], key=order), sorted(own, key=order), strict=True):
            assert a[:2] == b[:2] and (a[2] is None) == (b[2] is None)
            assert b[2] is None or abs(a[2]) == pytest.approx(b[2], rel=1e-6, abs=1e-6)
            assert a[3] == pytest.approx(b[3], rel=1e-6, abs=1e-12)


def made(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c", "d") for i, v in rows], SCHEMA)


def test_against_a_plain_version(spark):
    rng = np.random.default_rng(3)
    spread = rng.normal(size=(20, 20))
    rows = [(i, (rng.normal(size=20) @ spread).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)] + [(7, rows[7][1]), (None, rows[8][1])]
    rows += [(2000, None), (2001, []), (2002, [1.0, None] * 10), (2003, [float("nan")] * 20), (2004, [float("inf")] + [0.0] * 19)]
    rows += [(3000 + i, rng.normal(size=3).tolist()) for i in range(30)]
    held(rows, whitening.whiten(made(spark, rows).repartition(5)).collect())


def test_signs_are_the_same_for_all_rows_and_runs(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(100)]
    one = {(r.vec_id, r.component): r.whitened for r in whitening.whiten(made(spark, rows).repartition(7)).collect()}
    two = {(r.vec_id, r.component): r.whitened for r in whitening.whiten(made(spark, rows).repartition(2)).collect()}
    assert all(one[k] == pytest.approx(two[k], abs=1e-9) for k in one)
    y = np.array([[one[i, c] for c in range(1, 7)] for i in range(100)])
    assert np.abs(y.T @ y / 100 - np.eye(6)).max() < 1e-9


def test_degenerate_tables(spark):
    assert whitening.whiten(made(spark, [])).collect() == []
    assert whitening.whiten(made(spark, [(1, None)])).collect() == []
    alone = whitening.whiten(made(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(alone) == 4 and all((r.n, r.deviation, r.whitened, r.explained) == (1, 0, None, 0.0) for r in alone)
    flat = [(i, [float(i), 5.0, 2.0 * i]) for i in range(9)]
    got = whitening.whiten(made(spark, flat)).collect()
    assert {r.component: r.whitened is None for r in got} == {1: False, 2: True, 3: True}
    held(flat, got)


def test_exact_beyond_64_bits():
    x = np.array([[1 << 61, -(1 << 61)], [3, 5], [1 << 60, 7]], np.int64)
    sums = whitening.exact_sums(np.repeat(x, 5, axis=0))
    assert sums.tolist() == [5 * ((1 << 61) + 3 + (1 << 60)), 5 * (12 - (1 << 61))]
    whole = whitening.centred(x, 15, sums)
    assert whitening.deviations(whole) == [sum((15 * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]


def test_huge_entries_do_not_crash(spark):
    got = whitening.whiten(made(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])])).collect()
    assert len(got) == 6 and all(r.n == 3 for r in got)


def test_the_query(spark):
    frame = whitening.op11_whitening(spark, "/root/testdata/sf0.001")
    assert dict(frame.dtypes)["deviation"] == "bigint"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    held(rows, frame.collect())
