from __future__ import annotations

import hashlib
import math
import random

from pyspark.sql import functions as F

from larkspan.llm import exact_dedup, mixing, simhash, topk


def test_exact_dedup(spark):
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (None, "a"), (None, "z"), (6, "long " * 50_000), (7, "long " * 50_000), (8, "A"), (9, "q"), (9, "q")]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, keep_id string")
    got = sorted((tuple(r) for r in exact_dedup.exact_dedup(docs).collect()), key=repr)
    want = []
    for n, (i, t) in enumerate(rows):
        same = [j for j, u in rows if (u or "") == (t or "")]
        keep = max((j for j in same if j is not None), default=None)
        first = not any(r == (i, t) for r in rows[:n])
        want.append((i, keep, len(same), i == keep and first, hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    kept = exact_dedup.keep_distinct(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, (r.text or "")[:2]) for r in kept.filter("doc_id IS NOT NULL").collect()) == [(2, "b"), (3, "a"), (5, ""), (7, "lo"), (8, "A"), (9, "q")]
    assert kept.filter("doc_id IS NULL").count() == 1
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0
    smallest = exact_dedup.exact_dedup(docs, keep="smallest", runs=5, fan_in=2).filter("text_sha256 = sha2('a', 256)").first()
    assert smallest.keep_id == 1 and smallest.group_size == 3


def brute_top(vectors, k):
    whole = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.setdefault(i, []).append([math.floor(1024 * x) for x in v])
    out = []
    for q in sorted(i for i in whole if i % 100 == 0):
        scored = [(-sum(a * b for a, b in zip(min(whole[q]), v, strict=True)), i) for i, vs in whole.items() if i != q for v in vs if len(v) == len(whole[q][0])]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def test_exact_top_k(spark):
    rng = random.Random(3)
    vectors = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(7)]) for i in range(350)]
    vectors += [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 7), (403, [float("inf")] + [0.0] * 6), (None, [1.0] * 7), (404, [1.0] * 3), (500, [1.0, 2.0, 3.0]), (600, [])]
    vectors += [(20, vectors[20][1])] * 3 + [(700, [1e5] * 7), (701, [2e5] * 7)]
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id long, embedding array<double>, score int").repartition(5)
    got = sorted(tuple(r) for r in topk.exact_top_k(df.filter(F.col("vec_id") % 100 == 0), df, k=10, block=2).collect())
    assert got == sorted(brute_top(vectors, 10))
    assert topk.exact_top_k(df.limit(0), df).count() == 0


def test_mix(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["a", "b", "c", "d", None])) for i in range(400)] + [(None, "x y", "a"), (500, None, "e"), (3, "x", "a"), (3, "x", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [r.asDict() for r in mixing.mix(docs).collect()]
    assert len(got) == len(rows)
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, full, left = {}, set(), 1.5 * sum(sizes.values())
    while True:
        share = left / sum(weights[s] for s in order if s not in full)
        over = [s for s in order if s not in full and weights[s] * share > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            full.add(s)
            target[s] = 2.0 * sizes[s]
            left -= target[s]
    target |= {s: weights[s] * share for s in order if s not in full}
    by_size = {v: s for s, v in sizes.items()}
    taken = {}
    for r in got:
        s = by_size[r["source_size"]]
        assert abs(r["target"] - target[s]) < 1e-6 * max(1, target[s])
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - target[s]) <= 3 for s in taken)
    assert sorted(map(str, got)) == sorted(map(str, (r.asDict() for r in mixing.mix(docs.repartition(7)).collect())))
    applied = mixing.apply_mix(docs)
    assert applied.columns == docs.columns
    assert abs(applied.selectExpr("sum(size(filter(split(coalesce(text, ''), ' '), x -> x <> '')))").first()[0] - sum(taken.values())) <= 6
    assert mixing.mix(docs.limit(0)).count() == 0


def test_representatives(spark):
    rows = [(5, "a b c d e f"), (2, "a b c d e f"), (9, "other words here"), (1, None), (4, "")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, _stay int")
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 9]
