from __future__ import annotations

import random

import numpy as np
import pytest

from larkspan.llm import simhash
from larkspan.llm.components import components, forest
from tests.llm import brute

SCHEMA = "doc_id long, text string, fingerprint string"


def groups(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in simhash.simhash_groups(docs, **options).collect()), key=repr)


def test_against_brute_force(spark):
    rng = random.Random(1)
    words = [f"Wörd{i}" for i in range(300)]
    rows = []
    for i in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(1, 150))]
        rows.append((i, " ".join(base)))
        for j in range(rng.randint(0, 3)):
            edited = list(base)
            edited[rng.randrange(len(base))] = rng.choice(words)
            rows.append((100 + 10 * i + j, "\t".join(edited)))
    rows += [(900, None), (901, ""), (902, " \n "), (None, rows[0][1]), (3, rows[3][1]), (904, "one")]
    assert groups(spark, rows) == brute.simhash_groups(rows)
    assert groups(spark, []) == []


@pytest.mark.parametrize("most", [1024, 5])
def test_links_of_crowded_fingerprints(spark, most):
    """Many fingerprints near one another, in small buckets and, with most=5, by way of hubs."""
    rng = random.Random(most)
    values = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            values.add(x)
    values |= {rng.getrandbits(64) for _ in range(200)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    distinct = spark.createDataFrame([(signed(x),) for x in values], "fp long")
    label = {r.u: r.v for r in components(simhash.linked(distinct, 4, most)).collect()}
    values = sorted(map(signed, values))
    parent = {x: x for x in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(values):
        for b in values[k + 1 :]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {x: label.get(x, x) for x in values} == {x: root(x) for x in values}


def test_forest_and_long_chain(spark):
    u, v = forest(np.array([5, 4, 9]), np.array([4, 3, 8]))
    assert dict(zip(u.tolist(), v.tolist(), strict=True)) == {4: 3, 5: 3, 9: 8}
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 99)], "u long, v long")
    assert {r.u: r.v for r in components(chain).collect()} == {**{i: 0 for i in range(1, 61)}, 100: 99}


def test_bits_are_even():
    with pytest.raises(ValueError):
        simhash.Ring(3)
