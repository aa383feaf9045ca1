"""The classifier's scores against a plain version, and cases at the edges."""

from __future__ import annotations

import math
import random

import pyarrow as pa
import pytest

from larkspan.llm import quality

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15


def spread(h, kind):
    h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 + kind) & MASK
    return h ^ (h >> 32)


def plain_score(text, model):
    """Feature by feature, in Python's integers."""
    size, total, count = model.settings.buckets, 0.0, 0
    words = text.split()
    own = []
    for word in words:
        codes = [ord(c) for c in f"<{word}>"]
        h = spread(sum(c * pow(BASE, k, 1 << 64) for k, c in enumerate(codes)) & MASK, 1) % size
        own.append(h)
        found = [h]
        for n in model.settings.grams:
            for i in range(len(codes) - n + 1):
                g = 0
                for c in codes[i : i + n]:
                    g = (g * BASE + c) & MASK
                found.append(spread(g, n) % size)
        total += sum(model.weight[f] for f in found)
        count += len(found)
    for a, b in zip(own, own[1:], strict=False):
        total += model.weight[a ^ b]
        count += 1
    return 1 / (1 + math.exp(-(model.bias + (total / count if count else 0.0))))


def test_scores_against_a_plain_version():
    rng = random.Random(11)
    settings = quality.Settings(buckets=1 << 10)
    model = quality.Model(quality.np.random.default_rng(2).normal(size=1 << 10), 0.3, settings)
    texts = ["", " ", "one", "a a a b", " lead and trail ", "x" * 5000 + " y", "日本語 é é 🙂", "word " * 3000]
    texts += [" ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    got = quality.Scorer(model).scores(pa.array(texts))
    assert got.tolist() == pytest.approx([plain_score(t, model) for t in texts], abs=1e-9)
    assert [quality.Scorer(model).score(t) for t in texts] == got.tolist()


def test_scores_do_not_depend_on_the_texts_beside(monkeypatch):
    model = quality.Model(quality.np.random.default_rng(3).normal(size=1 << 16), 0.0, quality.SETTINGS)
    texts = [f"text {i} with some words {i % 7}" for i in range(200)]
    whole = quality.Scorer(model).scores(pa.array(texts)).tolist()
    monkeypatch.setattr(quality, "BATCH", 64)
    assert quality.Scorer(model).scores(pa.array(texts)).tolist() == whole


def test_empty_table_and_clashing_columns(spark):
    schema = "doc_id long, text string, score string, id int, held_out int, predicted string"
    docs = spark.createDataFrame([(1, "a b", "s", 1, 1, "p"), (1, "a b", "s", 1, 1, "p")], schema)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    rows = quality.score_documents(docs, model).collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0].predicted == 1
    assert quality.score_documents(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0
    assert quality.keep_good(docs.limit(0), model).columns == docs.columns


def test_held_out_accuracy(spark):
    """On the test tables: labels that were not learnt from are predicted."""
    sf = "/root/testdata/sf0.01"
    out = quality.op3_quality(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("predicted", "quality").collect()
    assert len(out) > 80 and sum(r.predicted == r.quality for r in out) >= 0.97 * len(out)
