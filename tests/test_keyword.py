"""BM25 against a plain version, with phrases, prefixes, marks and groups."""

from __future__ import annotations

import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from larkspan.functions.text import index_tokens
from larkspan.operators import keyword
from larkspan.operators.nearest import nearest


def tokens(text):
    bare = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.category(c).startswith("M"))
    return [t for t in re.split(r"[\W_]+", bare) if t]


def times(have, phrase, prefix):
    n = len(phrase)
    same = lambda a, b, last: a.startswith(b) if prefix and last else a == b
    return sum(all(same(have[i + k], p, k == n - 1) for k, p in enumerate(phrase)) for i in range(len(have) - n + 1))


def plain(queries, texts, k):
    have = {i: tokens(t or "") for i, t in texts}
    average = sum(map(len, have.values())) / len(have)
    out = []
    for query, text in queries:
        terms = [t for t in re.split(r"[^\w]+", text) if t]
        phrases = [(tokens(t), i == len(terms) - 1) for i, t in enumerate(terms)]
        scores = {}
        for phrase, prefix in phrases:
            if not phrase:
                continue
            found = {i: f for i, h in have.items() if (f := times(h, phrase, prefix))}
            idf = max(math.log((len(have) - len(found) + 0.5) / (len(found) + 0.5)), 1e-6)
            for i, f in found.items():
                scores[i] = scores.get(i, 0) + idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(have[i]) / average))
        best = sorted((-round(s, 6), i) for i, s in scores.items())[:k]
        out += [(query, i, -s, rank) for rank, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_against_a_plain_version(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "al", "Ärger", "ế", "x_y", "naïve", "a_b", "ab"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(300)] + [(300, None), (301, "a far b"), (302, "a b")]
    queries = [(1, "alpha be"), (2, "a_b alpha"), (3, "gamma x_y"), (4, "e a_b"), (5, ""), (6, "arger naive al"), (7, "alpha alpha zzz"), (8, "___"), (9, "nothing here q")]
    t = spark.createDataFrame(texts, "hit_id long, text string").repartition(5)
    q = spark.createDataFrame(queries, "query_id long, text string")
    for block in (4096, 2):
        got = sorted(tuple(r) for r in keyword.keyword_top(q, t, 7, block=block).select("query_id", "hit_id", "score", "rank").collect())
        want = plain(queries, texts, 7)
        assert [(a, b, r) for a, b, _, r in got] == [(a, b, r) for a, b, _, r in want]
        assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-6)
    phrase = {r.hit_id for r in keyword.keyword_top(spark.createDataFrame([(1, "a_b zzzz")], "query_id long, text string"), t, 400).collect()}
    assert 302 in phrase and 301 not in phrase
    assert keyword.keyword_top(q, t.limit(0), 3).count() == 0 and keyword.keyword_top(q.limit(0), t, 3).count() == 0


def test_groups_and_names(spark):
    """Ids may be strings; a query sees its group only, the statistics are those of all texts."""
    t = spark.createDataFrame([("d1", "red fish", "g"), ("d2", "red bird", "h"), ("d3", "blue fish", "g")], "hit_id string, text string, grp string")
    q = spark.createDataFrame([("q1", "red fish", "g"), ("q2", "red fish", "h"), ("q3", "red fish", None)], "query_id string, text string, grp string")
    got = sorted((r.query_id, r.rank, r.hit_id) for r in keyword.keyword_top(q, t, 5, same_group=True).collect())
    assert got == [("q1", 1, "d1"), ("q1", 2, "d3"), ("q2", 1, "d2")]
    some = keyword.keyword_top(q.select("query_id", "text"), t, 5, F.col("hit_id") != "d1")
    assert {r.hit_id for r in some.collect()} == {"d2", "d3"}


def test_marks_are_folded(spark):
    row = spark.range(1).select(index_tokens(F.lit("ế ά й É Ǻ naïve ệ")).alias("t")).first()
    assert row.t == ["e", "α", "и", "e", "a", "naive", "e"]


def test_nearest_keeps_ties_to_smaller_ids(spark):
    rows = [(i, [1.0, float(i % 3)]) for i in range(3000)] + [(5000, None), (5001, [1.0, None]), (5002, [1.0])]
    v = spark.createDataFrame(rows, "hit_id long, embedding array<double>").repartition(4)
    got = nearest(spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>"), v, 5).orderBy("rank").collect()
    assert [r.hit_id for r in got] == [0, 3, 6, 9, 12] and [r.rank for r in got] == [1, 2, 3, 4, 5]
