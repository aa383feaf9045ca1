"""The stored index against keyword search over the texts, and its way of leaving postings out."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.operators import inverted, keyword
from larkspan.operators.inverted import BLOCK, best_of, build_index, maxima

WORDS = [f"w{i}" for i in range(40)] + ["foo-bar", "foo_baz", "É", "the", "then", "x.y"]


def texts(rng, count, first=0):
    return [(first + i, " ".join(rng.choices(WORDS, [1 / (j + 1) for j in range(len(WORDS))], k=rng.randrange(0, 60))) if i % 17 else None, f"g{i % 3}", f"s{i % 4}", "x") for i in range(count)]


def asked(rng, count):
    rows = [(i, " ".join(rng.choice([*WORDS, "th", "w1", "foo-b", "nothere"]) for _ in range(rng.randrange(0, 5))), f"g{i % 3}") for i in range(count)]
    return [*rows, (900, None, "g0"), (901, "the the then", "g1"), (902, "foo-bar w1", "g2"), (903, "w0 w0 w0", None)]


SCHEMA = "hit_id long, text string, grp string, source string, term2 string"


def same(found, expected):
    rows = lambda df: sorted((r.query_id, r["rank"], r.hit_id, r.score) for r in df.collect())
    assert rows(found) == rows(expected)


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rng = random.Random(3)
    rows, queries = texts(rng, 700), spark.createDataFrame(asked(rng, 60), "query_id long, text string, grp string")
    folder = "file://" + str(tmp_path_factory.mktemp("index"))
    old, new = inverted.SHARD, 3000
    inverted.SHARD = new
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    index = build_index(frame, folder, ("source",))
    inverted.SHARD = old
    return index, frame, queries


def test_equal_to_a_search_of_the_texts(world):
    index, frame, queries = world
    assert index.docs().select("shard").distinct().count() > 3
    same(index.search(queries, 5), keyword.keyword_top(queries, frame, 5))
    same(index.search(queries, 10, block=7), keyword.keyword_top(queries, frame, 10))


def test_filters_and_groups_come_before_the_ranking(world):
    index, frame, queries = world
    same(index.search(queries, 4, F.col("source") == "s1"), keyword.keyword_top(queries, frame, 4, F.col("source") == "s1"))
    same(index.search(queries, 4, same_group=True), keyword.keyword_top(queries, frame, 4, same_group=True))
    same(keyword.keyword_top(queries, index, 4), keyword.keyword_top(queries, frame, 4))


def test_postings_and_statistics(world):
    index, frame, _ = world
    own = sorted(map(tuple, index.postings().select("hit_id", "term", "tf", "doc_len").collect()))
    assert own == sorted(map(tuple, keyword.postings(frame).select("hit_id", "term", "tf", "doc_len").collect()))
    assert index.statistics().first() == keyword.statistics(frame.fillna("", ["text"])).first()


def test_a_search_reads_the_index_alone_and_only_the_buckets_it_needs(world):
    index, _, queries = world
    from larkspan.operators.keyword import Asked, query_phrases

    one = queries.filter("query_id = 903").withColumn("grp", F.lit(None).cast("string"))
    block = Asked(query_phrases(one).withColumn("grp", F.lit(None).cast("string")).collect())
    terms = index._terms(index.spark.sparkContext.broadcast(block))
    assert [tuple(r) for r in terms.collect()] == [("w0", inverted.bucket_of("w0"))]
    text = index.table("postings").join(F.broadcast(terms), ["bucket", "term"])._jdf.queryExecution().optimizedPlan().toString()
    assert "dynamicpruning" in text


@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_terms_too_many_to_send_are_joined(world, sent, monkeypatch):
    index, frame, queries = world
    monkeypatch.setattr(inverted, "SENT", sent)
    same(index.search(queries, 3), keyword.keyword_top(queries, frame, 3))


def test_segments_deletion_and_return(spark, tmp_path):
    rng = random.Random(5)
    first, second = texts(rng, 120), texts(rng, 80, 1000)
    queries = spark.createDataFrame(asked(rng, 30), "query_id long, text string, grp string")
    index = build_index(spark.createDataFrame(first, SCHEMA), f"file://{tmp_path}/i")
    index.extend(spark.createDataFrame(second, SCHEMA))
    same(index.search(queries, 5), keyword.keyword_top(queries, spark.createDataFrame(first + second, SCHEMA), 5))
    gone = {r[0] for r in first[::3]} | {first[-1][0]}
    index.remove(spark.createDataFrame([(i,) for i in gone], "hit_id long"))
    left = [r for r in first + second if r[0] not in gone]
    same(index.search(queries, 5), keyword.keyword_top(queries, spark.createDataFrame(left, SCHEMA), 5))
    back = [(first[0][0], "w0 foo-bar again", "g0", "s0", "x")]
    index.extend(spark.createDataFrame(back, SCHEMA))
    same(index.search(queries, 5), keyword.keyword_top(queries, spark.createDataFrame(left + back, SCHEMA), 5))
    again = inverted.InvertedIndex(spark, f"file://{tmp_path}/i")
    assert again.segments() == [0, 1, 2] and again.statistics().first() == index.statistics().first()


def test_an_unfinished_segment_does_not_exist(spark, tmp_path):
    index = build_index(spark.createDataFrame([(1, "a b", None, "s", "x")], SCHEMA), f"file://{tmp_path}/i")
    build_index(spark.createDataFrame([(2, "a c", None, "s", "x")], SCHEMA), f"file://{tmp_path}/i")
    (tmp_path / "i/docs/segment=1/_SUCCESS").unlink()
    found = index.search(spark.createDataFrame([(1, "a b")], "query_id long, text string"), 5).collect()
    assert index.segments() == [0] and [r.hit_id for r in found] == [1]


def test_empty_tables_and_string_ids(spark, tmp_path):
    queries = spark.createDataFrame([(1, "a b")], "query_id long, text string")
    with pytest.raises(ValueError, match="no index"):
        inverted.InvertedIndex(spark, f"file://{tmp_path}/none").search(queries, 5)
    index = build_index(spark.createDataFrame([], "hit_id string, text string"), f"file://{tmp_path}/i")
    assert index.search(queries, 5).collect() == []
    index.extend(spark.createDataFrame([("d:0", ""), ("d:1", "b a"), (None, "a")], "hit_id string, text string"))
    assert [r.hit_id for r in index.search(queries, 5).collect()] == ["d:1"]
    assert index.search(queries.limit(0), 5).collect() == []
    with pytest.raises(ValueError, match="columns of its own"):
        index.extend(spark.createDataFrame([("d", "", 1)], "hit_id string, text string, size int"), ("size",))


def test_postings_below_the_cutoff_are_left_out():
    rng = np.random.default_rng(1)
    sizes = rng.integers(5, 300, 20_000)
    rare, often = np.sort(rng.choice(20_000, 50, replace=False)), np.sort(rng.choice(20_000, 15_000, replace=False))
    lists = []
    for docs, weight in ((rare, 6.0), (often, 0.2)):
        times = rng.integers(1, 4, len(docs))
        lists.append((docs, times, *maxima(docs, times, sizes), weight))
    allowed = np.ones(20_000, bool)
    docs, scores, looked = best_of(lists, sizes, allowed, 100.0, 10, -np.inf)
    _, _, every = best_of(lists, sizes, allowed, 100.0, 20_000, -np.inf)
    whole, exact, _ = best_of(lists, sizes, allowed, 100.0, 20_000, -np.inf)
    assert looked < 2 * len(rare) and every > 15_000
    assert docs.tolist() == whole[:10].tolist() and scores.tolist() == exact[:10].tolist()
    assert best_of(lists, sizes, allowed, 100.0, 10, 1e9)[2] == 0 and len(lists[1][2]) == -(-15_000 // BLOCK)
