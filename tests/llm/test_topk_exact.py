from __future__ import annotations

from larkspan.llm import topk


def test_sums_beyond_exact_floats(spark):
    """Each segment's product is below 2 ** 53, their sum is not."""
    rows = [(0, [94_000_000.0 / 1024] * 3 + [94_000_001.0 / 1024]), (1, [94_000_000.0 / 1024] * 3 + [94_000_001.0 / 1024]), (2, [94_000_000.0 / 1024] * 2 + [94_000_001.0 / 1024] * 2)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.exact_top_k(vectors.filter("vec_id = 0"), vectors).orderBy("rank").collect()
    whole = {i: [int(x * 1024) for x in v] for i, v in rows}
    want = sorted((-sum(a * b for a, b in zip(whole[0], whole[i], strict=True)), i) for i in (1, 2))
    assert [(-r.score, r.vec_id) for r in got] == want and -want[0][0] > 1 << 53


def test_crowds_of_equal_scores(spark):
    """Ties beyond k, most of them copies of one vector, go to the smaller ids; a third of the rows hold nothing."""
    rows = [(i, [1.0, 0.5]) for i in range(1, 60)] + [(0, [1.0, 1.0])] + [(100 + i, None) for i in range(30)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    got = topk.exact_top_k(vectors.filter("vec_id = 0"), vectors, k=7).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(1, 8)) and [r.rank for r in got] == list(range(1, 8))
