from __future__ import annotations

import pytest

from larkspan.llm import quality


def test_training_sees_all_features_of_a_document(spark, monkeypatch):
    text = " ".join(f"{i:05d}x{i * 7919 % 100003:05d}" for i in range(1500))
    docs = spark.createDataFrame([(1, text), (2, "short text here")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "held_out", lambda id_col: quality.F.lit(False))
    seen = {}
    monkeypatch.setattr(quality, "train", lambda examples, settings: seen.update({label: (f.tolist(), s) for f, s, label in examples}))
    quality.fit(docs, labels)
    wanted = quality.document_features(text, quality.SETTINGS)
    features, shares = seen[1]
    assert len(wanted) > 2000 and set(features) == set(wanted) and len(features) == len(wanted)
    assert shares.tolist() == pytest.approx([wanted[f] / sum(wanted.values()) for f in features])
