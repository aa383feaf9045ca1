from __future__ import annotations

import random

import pytest

from larkspan.llm.suffix_dedup import remove_repeats
from tests.llm import brute

SCHEMA = "doc_id long, text string, body string"


def result(spark, rows, length, gram):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in remove_repeats(docs, length=length, gram=gram).drop("kept").collect()), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_random_texts_with_shared_passages(spark, seed):
    rng = random.Random(seed)
    letters = "ab" if seed == 3 else "abcdefgh é\n"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [word(rng.randint(20, 200)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [word(rng.randint(0, 120)) for _ in range(3)] + rng.sample(passages, rng.randint(0, 3))
        rng.shuffle(parts)
        rows.append((i, "".join(parts)))
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, "z" * 300), (103, None), (104, ""), (None, rows[1][1]), (7, rows[7][1])]
    length = 24 if seed == 3 else 40
    assert result(spark, rows, length, 6) == brute.remove_repeats(rows, length)


def test_segments_of_a_long_text(spark, monkeypatch):
    from larkspan.llm import suffix_dedup

    rng = random.Random(5)
    long = "".join(rng.choice("abcdefghij") for _ in range(600_000))
    rows = [(1, long), (2, long[250_000:270_000]), (3, "xy" + long[:900]), (4, "q" * 500)]
    got = {r[0]: r[1:4] for r in result(spark, rows, 400, 64)}
    assert got[2] == (20_000, 20_000, 1)
    assert got[3] == (902, 900, 1)
    assert got[1] == (600_000, 20_900, 2)
    assert got[4] == (500, 500, 1)
    assert suffix_dedup.SEGMENT < 600_000


def test_empty_table_and_bad_parameters(spark):
    assert result(spark, [], 40, 6) == []
    with pytest.raises(ValueError):
        remove_repeats(spark.createDataFrame([], SCHEMA), length=40, gram=30)
