from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspan.llm import runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, runs string, body string, n string"


def plain_runs(words, least=24, times=3):
    """[(start, length, period)]: every period's maximal stretches, those with a smaller period left out."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_row(doc_id, text, least=24, times=3):
    words = WORD.findall(text or "")
    if doc_id is not None and words and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    own = sorted(plain_runs(words, least, times), key=lambda r: (r[0], r[2]))
    gone = {i for s, length, q in own for i in range(s + q, s + length)}
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(own, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in own)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(own), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(left))


def by_names(texts, least=24, times=3):
    """What find_runs gives for texts that lie one behind the other."""
    codes = {}
    keys = np.array([codes.setdefault((i, w), len(codes)) for i, t in enumerate(texts) for w in t], np.int64)
    out, begun = [], 0
    rows = runs.find_runs(keys, least, times).tolist()
    for t in texts:
        out.append(sorted((s - begun, e - s, q) for s, e, q in rows if begun <= s < begun + len(t)))
        begun += len(t)
    assert sum(map(len, out)) == len(rows)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4), st.sampled_from([(24, 3), (4, 3), (1, 3), (9, 4), (40, 3)]))
def test_random_texts(texts, kind):
    assert by_names(texts, *kind) == [plain_runs(t, *kind) for t in texts]


@pytest.mark.parametrize("lots", [7, 1 << 20])
def test_planted_periods_of_every_size(lots, monkeypatch):
    monkeypatch.setattr(runs, "CANDIDATES", lots)
    rng = random.Random(5)
    texts = []
    for q in [*range(1, 70), 127, 128, 129, 255, 300]:
        block = [rng.randrange(1 if q % 9 == 0 else 50) for _ in range(q)]
        length = max(24, 3 * q) + rng.choice([-1, 0, 1, q])
        texts.append([rng.randrange(50) for _ in range(rng.randrange(40))] + (block * (length // q + 1))[:length] + [rng.randrange(50) for _ in range(rng.randrange(40))])
    texts += [[1] * 400, [1, 2] * 100 + [2, 1] * 100, ([1] * 30 + [2]) * 8, [], [1]]
    assert by_names(texts) == [plain_runs(t) for t in texts]


def test_a_long_text_of_one_word_and_one_without_repeats():
    assert by_names([[7] * 100_000, list(range(100_000))]) == [[(0, 100_000, 1)], []]


def made(spark, rows):
    return spark.createDataFrame([(i, t, "r", "b", "n") for i, t in rows], SCHEMA)


def test_frames(spark, monkeypatch):
    monkeypatch.setattr(runs, "WORDS", 50)
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 300)))) for i in range(120)]
    rows += [(900, "a b c " * 40), (900, "a b c " * 40), (None, "x " * 50), (901, None), (902, ""), (903, " \t\r\n\x0b"), (904, "é ü  " * 30), (905, "long" * 300_000 + " z" * 30)]
    docs = made(spark, rows).repartition(5)
    out = runs.collapse_runs(docs)
    assert out.columns == ["doc_id", "text", "body", "n", "runs", "collapsed"]
    got = sorted(((r.doc_id, r.text, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()), key=repr)
    expected = []
    for i, t in rows:
        words = WORD.findall(t or "")
        own = plain_runs(words)
        gone = {j for s, n, q in own for j in range(s + q, s + n)}
        expected.append((i, t, sorted(own, key=lambda r: (r[0], r[2])), " ".join(w for j, w in enumerate(words) if j not in gone)))
    assert got == sorted(expected, key=repr)
    assert runs.collapse_runs(docs.limit(0)).collect() == []


def test_the_query(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, "\t".join(f"w{rng.randrange(9 if i % 3 else 2)}" for _ in range(rng.randrange(0, 200)))) for i in range(300)] + [(None, "y " * 30), (5000, None), (10, " "), (7, "a b " * 20 + "c d " * 20)]
    made(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = runs.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    found = sorted((tuple(r) for r in got.collect()), key=repr)
    assert found == sorted((plain_row(i, t) for i, t in rows), key=repr) and sum(r[1] > 0 for r in found) > 20


def test_the_query_on_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in runs.op12_periodic_runs(spark, "/root/testdata/sf0.001").collect())
    short = {r.doc_id: r.text for r in docs if len(r.text) < 6000}
    assert len(got) == len(docs) and [r for r in got if r[0] in short] == sorted(plain_row(i, t) for i, t in short.items())
