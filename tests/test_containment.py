from __future__ import annotations

import random

from larkspan.operators.containment import containing
from larkspan.operators.inverted import build_index


def test_against_a_look_at_every_pair(spark, tmp_path):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)] + ["Élan", "ΑΩ", "foo_bar", "a.b", "日本"]
    texts = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 40)))) for i in range(150)] + [(500, None), (501, ""), (502, "...")]
    passages = []
    for i in range(80):
        text = texts[rng.randrange(150)][1]
        begin = rng.randrange(len(text) + 1)
        passages.append((i, text[begin : begin + rng.choice([1, 2, 4, 9, 30, 80])]))
    passages += [(900, "w1 nothere w2 w3"), (901, None), (902, "w1  w2"), (903, "w3 w4 w5 w6"), (903, "w3 w4 w5 w6")]
    frame = spark.createDataFrame(texts, "hit_id long, text string")
    index = build_index(frame, f"file://{tmp_path}/i")
    got = containing(spark.createDataFrame(passages, "query_id long, passage string"), frame, index)
    expected = {(q, h) for q, p in passages for h, t in texts if p and t and any(c.isalnum() for c in p) and p in t}
    assert sorted(map(tuple, got.collect())) == sorted(expected) and len(expected) > 100
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert containing(spark.createDataFrame([], "query_id long, passage string"), frame, index).collect() == []
