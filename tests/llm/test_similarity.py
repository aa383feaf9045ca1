from __future__ import annotations

import random

import pytest

import corpus_pipeline
from larkspan.llm import simhash, similarity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def groups(rows):
    """Plain version: every pair is compared."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = sets[i] | sets[j]
            if 5 * len(sets[i] & sets[j]) >= 4 * len(both):
                parent[root(i)] = root(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[root(i)] = min(low.get(root(i), doc), doc)
    return sorted(((doc, low.get(root(i))) for i, (doc, _) in enumerate(rows)), key=repr)


def sample():
    """Texts with copies around a similarity of 0.8, chains of them, a passage that many have, and odd rows."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(words) for _ in range(30)]
    rows = []
    for i in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 8, 60, 120, 300]))] + (passage if i % 2 else [])
        rows.append((10 * i, " ".join(base)))
        for j in range(1, rng.randint(1, 7)):
            base = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                base[rng.randrange(len(base))] = rng.choice(words)
            rows.append((10 * i + j, "\t".join(base).upper()))
    return rows + [(900, None), (901, ""), (902, " \n "), (None, rows[0][1]), (3, rows[3][1]), (None, "only null ids")]


@pytest.mark.parametrize("most", [similarity.SAMPLE, 1])
def test_against_every_pair(spark, monkeypatch, most):
    monkeypatch.setattr(similarity, "SAMPLE", most)
    rows = sample()
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    got = sorted((tuple(r) for r in similarity.similar_groups(docs).collect()), key=repr)
    assert got == groups(rows) and len({c for _, c in got}) < len(rows) - 20
    assert similarity.similar_groups(docs.limit(0)).count() == 0


def test_pipeline_drops_every_near_copy(spark, tmp_path):
    """Pairs at a similarity of 0.8 or a little more, whose fingerprints mostly differ in more than six bits."""
    rng = random.Random(8)
    rows = []
    for i in range(20):
        words = [f"w{rng.randrange(5000)}" for _ in range(204)]
        rows.append((2 * i, " ".join(words)))
        for at in (30, 80, 130, 180):  # 20 of 200 shingles change: 180 / 220
            words[at] = "other"
        rows.append((2 * i + 1, " ".join(words)))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    kept = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 40, 2))


def test_fingerprints_name_the_first_candidates(spark, tmp_path, monkeypatch):
    """Of each three texts the first two differ in a word of 400, which leaves most fingerprints within four bits."""
    rng = random.Random(3)
    rows, asked = [], []
    for i in range(12):
        words = [f"w{rng.randrange(9000)}" for _ in range(400)]
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join([*words[:-1], "end"])), (3 * i + 2, " ".join(rng.sample(words, 400)))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    named = similarity.fingerprinted

    def spy(*args):
        asked.append(named(*args))
        return asked[-1]

    monkeypatch.setattr(similarity, "fingerprinted", spy)
    monkeypatch.setattr(similarity, "discard", lambda *tables: None)
    kept = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({3 * i for i in range(12)} | {3 * i + 2 for i in range(12)})
    node = {similarity.node_of(similarity.shingle_set(t.encode(), 5)): i for i, t in rows}
    prints = {i: simhash.fingerprint(t.encode(), 5) for i, t in rows}
    found = {tuple(sorted((node[r.u], node[r.v]))) for r in asked[0].collect()}
    assert found == {(3 * i, 3 * i + 1) for i in range(12) if (prints[3 * i] ^ prints[3 * i + 1]).bit_count() <= 4} and len(found) >= 6
