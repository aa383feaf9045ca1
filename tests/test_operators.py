from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from larkspan.operators import changes, evaluation, fusion, keyword, limits
from larkspan.operators.nearest import nearest
from larkspan.schemas import NOTES, conform, fields


def test_fusion(spark):
    rows = [("q", "brave", 0, 1, "https://a.com/x?utm_source=1", "A"), ("q", "brave", 0, 2, "https://b.com", "B"), ("q", "google", 1, 1, "https://www.a.com/x#y", "A2"), ("q", "google", 1, 2, "https://c.com", "C")]
    got = fusion.fuse_providers(spark.createDataFrame(rows, "query_id string, provider string, provider_ord int, pos int, url string, title string")).orderBy(F.col("score").desc(), "key").collect()
    assert [r.title for r in got] == ["A", "B", "C"] and got[0].sources == ["brave", "google"] and got[0].provider_ranks == {"brave": 1, "google": 1}
    assert got[0].score == pytest.approx(2 / 61)


def test_metrics(spark):
    found = spark.createDataFrame([("a", x, i) for i, x in enumerate(["a", "b", "c", "d"], 1)] + [("n", x, i) for i, x in enumerate(["x", "a"], 1)] + [("d", x, i) for i, x in enumerate(["a", "a", "b"], 1)], "query_id string, id string, rank int")
    labels = spark.createDataFrame([("a", "a"), ("a", "c"), ("n", "a"), ("d", "a"), ("d", "b"), ("z", "q")], "query_id string, id string")
    got = {r.query_id: r for r in evaluation.query_metrics(found, labels, [1, 2, 3, 4, 5]).collect()}
    assert (got["a"].recall_1, got["a"].recall_3, got["a"].precision_2, got["a"].precision_4) == (0.5, 1.0, 0.5, 0.5)
    assert got["n"].ndcg_5 == pytest.approx(0.6309297) and got["d"].ndcg_5 == pytest.approx(1.0)
    assert got["z"].mrr == 0 and got["n"].mrr == 0.5


def test_provider_summary(spark):
    rows = [("bing", "ok", 2, 100.0, None), ("bing", "ok", 4, 200.0, None), ("bing", "empty", 0, 300.0, None), ("bing", "error", 0, 400.0, "429"), ("bing", "error", 0, 500.0, "429"), ("bing", "error", 0, 600.0, "timeout")]
    r = evaluation.provider_summary(spark.createDataFrame(rows, "provider string, status string, result_count int, duration_ms double, error string")).first()
    assert (r.p50_ms, r.p95_ms, r.avg_results, r.top_errors) == (300, 600, 1, "429 x2; timeout x1") and r.success_rate == pytest.approx(2 / 6)


def test_keyword_prefix_and_folding(spark):
    texts = spark.createDataFrame([(1, "Café server_name tuning"), (2, "tune the cafe"), (3, "nothing here")], "hit_id long, text string")
    asked = spark.createDataFrame([(1, "cafe tun"), (2, "server_name")], "query_id long, text string")
    got = {(r.query_id, r.hit_id) for r in keyword.keyword_top(asked, texts, 1000).collect()}
    assert got == {(1, 1), (1, 2), (2, 1)}


def test_namespace_before_top_k(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0], "x" if i == 5 else "y") for i in range(6)], "hit_id long, embedding array<double>, grp string")
    q = spark.createDataFrame([(9, [1.0, 0.0], "x")], "query_id long, embedding array<double>, grp string")
    assert [r.hit_id for r in nearest(q, v, 1, same_group=True).collect()] == [5]


def test_limits_against_plain_versions(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("ab"), rng.randint(0, 200_000), rng.choice(["ok", "no"])) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, k string, ms long, ok string").repartition(4)
    bucket = {r.event_id: r.allowed for r in limits.token_bucket(df, "k", "ms", "event_id", 5, 30).collect()}
    window = {r.event_id: r.allowed for r in limits.sliding_limit(df, "k", "ms", "event_id", 3, 10_000).collect()}
    breaker = {r.event_id: r.decision for r in limits.circuit_breaker(df, "k", "ms", "event_id", "ok", backoff_ms=20_000).collect()}
    for key in "ab":
        tokens, last, accepted, recent, until = 5.0, None, [], [], -1
        for i, _, t, ok in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0])):
            tokens = min(5.0, tokens + (t - (last if last is not None else t)) / 1000 * 0.5)
            last = t
            assert bucket[i] == (tokens >= 1)
            tokens -= tokens >= 1
            accepted = [x for x in accepted if x > t - 10_000]
            assert window[i] == (len(accepted) < 3)
            accepted += [t] * window[i]
            assert breaker[i] == ("backoff" if t < until else "called")
            if t >= until:
                recent = [*recent, ok == "ok"][-5:]
                until = t + 20_000 if len(recent) == 5 and sum(recent) <= 2 else until


def test_scopes_do_not_mix(spark):
    from larkspan.operators import notes

    rows = [(f"{s}{i}", "the word", "t", i, i, s, s, s) for s in ("local", "other") for i in range(4)]
    both = spark.createDataFrame(rows, "id string, text string, topic string, ts long, seq long, execution_mode string, tenant_id string, workspace_id string")
    for run in (lambda df: notes.evict(df, 2), lambda df: notes.search(df, "word", 2), lambda df: notes.listed(df, 3)):
        split = [run(both.filter(F.col("tenant_id") == s)).select("id").collect() for s in ("local", "other")]
        assert sorted(run(both).select("id").collect()) == sorted(split[0] + split[1])
    assert conform(both, NOTES).columns == [n for n, _ in fields(NOTES)]


def test_changes(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, s string, v int")
    new = spark.createDataFrame([(2, "c", 3), (3, "d", 4)], "k int, s string, v int")
    assert sorted(map(tuple, changes.upsert_add(old, new, ["k"], "v", "s").collect())) == [(1, "a", 1), (2, "b", 5), (3, "d", 4)]
    assert sorted(map(tuple, changes.insert_absent(old, new, ["k"]).collect())) == [(1, "a", 1), (2, "b", 2), (3, "d", 4)]
    assert sorted((r.k, r.action) for r in changes.capture(old, new, ["k"]).collect()) == [(1, "delete"), (2, "update"), (3, "insert")]
