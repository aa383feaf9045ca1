"""Streams with state that are stopped and go on, against plain versions."""

from __future__ import annotations

import random
from collections import OrderedDict, defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from larkspan.functions.chunks import chunks
from larkspan.operators import limits
from larkspan.streaming import embedding_queue, running, stateful
from larkspan.streaming.caches import lru_cache
from larkspan.streaming.traces import traces

BEGIN = datetime(2024, 1, 1, tzinfo=timezone.utc)


def add(spark, folder, rows, schema):
    """One file more for a stream over `folder`."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


REQUESTS = "event_id long, ts timestamp, scope string, url string"


def plain_cache(lots, capacity, ttl_ms):
    """{event: (outcome, evicted)}; requests of a lot in order of time, late ones at the time of the latest."""
    caches, clock, out = defaultdict(OrderedDict), defaultdict(int), {}
    for lot in lots:
        for event, ts, scope, url in sorted(lot, key=lambda r: (r[1], r[0])):
            own = caches[scope]
            now = clock[scope] = max(clock[scope], int(ts.timestamp() * 1000))
            if url in own and now - own[url] < ttl_ms:
                own.move_to_end(url)
                out[event] = ("hit", [])
                continue
            outcome = "expired" if url in own else "miss"
            own.pop(url, None)
            own[url] = now
            out[event] = (outcome, [own.popitem(last=False)[0]] if len(own) > capacity else [])
    return out


def test_cache_state_outlives_a_restart(spark, tmp_path):
    rng = random.Random(1)
    lots = [[(100 * n + i, BEGIN + timedelta(seconds=60 * n + rng.randrange(60)), f"s{rng.randrange(2)}", f"u{min(rng.randrange(9), rng.randrange(9))}") for i in range(40)] for n in range(4)]
    source, state = f"{tmp_path}/in", f"file://{tmp_path}/run"
    expected = plain_cache(lots, 3, 45_000)
    for n in (0, 2):
        add(spark, source, lots[n], REQUESTS)
        add(spark, source, lots[n + 1], REQUESTS)
        rows, _ = running.run(lru_cache(stream(spark, source, REQUESTS), "scope", "url", capacity=3, ttl_ms=45_000, late="1 hour"), state)
    got = rows.filter("event_id IS NOT NULL").collect()
    assert len(got) == 160 and {r.event_id: (r.outcome, r.evicted) for r in got} == expected
    assert {o for o, _ in expected.values()} == {"hit", "miss", "expired"} and any(e for _, e in expected.values())
    assert spark.conf.get(running._PROVIDER, None) in (None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")


def test_a_timer_sweeps_what_has_lived_its_time(spark, tmp_path):
    source, state = f"{tmp_path}/in", f"file://{tmp_path}/run"
    add(spark, source, [(1, BEGIN, "a", "x"), (2, BEGIN + timedelta(seconds=30), "a", "y")], REQUESTS)
    make = lambda: lru_cache(stream(spark, source, REQUESTS), "scope", "url", capacity=9, ttl_ms=60_000, late="1 second")
    running.run(make(), state)
    add(spark, source, [(3, BEGIN + timedelta(seconds=75), "b", "z")], REQUESTS)
    rows, _ = running.run(make(), state)
    swept = [(r.cache, r.evicted) for r in rows.filter("outcome = 'swept'").collect()]
    assert swept == [("a", ["x"])]


DOCUMENTS = "scope string, seq long, doc_id string, content string"


def letters(texts):
    return [[float(len(t)), float(len(texts)), float(t.count("a"))] if "skip" not in t else [0.0] for t in texts]


def test_queue_refuses_as_a_whole_and_serves_once_over_a_failure(spark, tmp_path):
    long = lambda n, word: "\n\n".join(f"{word} {i} " + "a few words more " * 60 for i in range(n))
    docs = [("s", 1, "d1", long(6, "one")), ("s", 2, "d2", long(9, "two")), ("s", 3, "d3", long(3, "three")), ("t", 1, "e1", long(2, "four")), ("t", 2, "e2", None), (None, 1, "f", "x"), ("t", 3, "e3", "to skip this text, which has no vector of the right length, though it is as long as a chunk has to be")]
    source, folder = f"{tmp_path}/in", f"file://{tmp_path}/run"
    add(spark, source, docs, DOCUMENTS)
    sizes = {r.doc_id: r.n for r in spark.createDataFrame(docs, DOCUMENTS).select("doc_id", F.size(chunks(F.trim(F.coalesce("content", F.lit(""))))).alias("n")).collect()}
    pending = sizes["d1"] + sizes["d3"]
    fails = []

    def owned():
        # The second batch with turns fails once after its chunks are written, before its vectors are.
        if len(fails) < 2:
            fails.append(1)
            if len(fails) == 2:
                raise RuntimeError("lost")
        return spark.createDataFrame([("s", f"{d}:{i}") for d in sizes for i in range(sizes[d]) if (d, i) != ("d1", 1)] + [("t", f"{d}:{i}") for d in sizes for i in range(sizes[d])], "scope string, chunk_id string")

    def go():
        return embedding_queue.serve(stream(spark, source, DOCUMENTS), folder, letters, 3, owned, pending=pending, served=4, every="0 seconds")

    query = go()
    with pytest.raises(Exception, match="lost"):
        query.awaitTermination(120)
    query = go()
    read = lambda name, schema: spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/{name}")
    wanted = {f"{d}:{i}" for d in ("d1", "d3", "e1") for i in range(sizes[d])} - {"d1:1"}
    try:
        for _ in range(120):
            query.awaitTermination(1)
            found = [r.chunk_id for r in read("vectors", "chunk_id string").collect()]
            if set(found) >= wanted:
                break
    finally:
        query.stop()
    assert sorted(found) == sorted(wanted)
    assert [tuple(r) for r in read("refused", "doc_id string, reason string").collect()] == [("d2", "embedding_queue_full")]
    written = [r.chunk_id for r in read("chunks", "chunk_id string").collect()]
    assert sorted(written) == sorted(wanted | {"d1:1"} | {f"e3:{i}" for i in range(sizes["e3"])})
    most = max(r.embedding[1] for r in read("vectors", "embedding array<double>").collect())
    assert most <= embedding_queue.BATCH and sizes["d2"] > 3


STAGES = "request string, ts timestamp, status string, duration_ms long"


def test_traces_end_with_the_watermark_and_late_stages_are_counted(spark, tmp_path):
    at = lambda s: BEGIN + timedelta(seconds=s)
    source, folder = f"{tmp_path}/in", f"file://{tmp_path}/run"
    lots = [
        [("a", at(20), "error", 5), ("a", at(0), "ok", 7), ("b", at(3), "skipped", 0)],
        [("a", at(40), "error", 1), ("b", at(100), "ok", 2)],
        [("c", at(200), "ok", 1), ("b", at(105), "empty", 3)],
        [("a", at(50), "ok", 9), ("a", at(90), "ok", 9), ("d", at(400), "ok", 4)],
    ]
    make = lambda: traces(stream(spark, source, STAGES), ["request"], "30 seconds", "60 seconds")
    late = 0
    for lot in lots:
        add(spark, source, lot, STAGES)
        rows, dropped = running.run(make(), folder)
        late += dropped
    got = sorted((r.request, int(r.start.replace(tzinfo=timezone.utc).timestamp() - BEGIN.timestamp()) if r.start.tzinfo is None else 0, r.stages, r.failed, r.skipped, r.total_ms) for r in rows.collect())
    assert got == [("a", 0, 3, 2, 0, 13), ("b", 3, 1, 0, 1, 0), ("b", 100, 2, 0, 0, 5), ("c", 200, 1, 0, 0, 1)]
    assert late == 2


EVENTS = "event_id long, ms long, k string"


def test_limiters_over_batches_and_a_restart_equal_those_of_a_table(spark, tmp_path):
    rng = random.Random(4)
    times = sorted(rng.randrange(120_000) for _ in range(240))
    rows = [(i, t, f"k{rng.randrange(3)}") for i, t in enumerate(times)]
    source = f"{tmp_path}/in"
    table = spark.createDataFrame(rows, EVENTS)
    for part in range(3):
        add(spark, source, rows[80 * part : 80 * part + 80], EVENTS)
        if part == 1:
            continue
        bucket, _ = running.run(stateful.token_bucket(stream(spark, source, EVENTS), "k", 5, 30), f"file://{tmp_path}/bucket")
        window, _ = running.run(stateful.sliding_limit(stream(spark, source, EVENTS), "k", 4, 9000), f"file://{tmp_path}/window")
    same = lambda a, b, *c: sorted(map(tuple, a.select("event_id", *c).collect())) == sorted(map(tuple, b.select("event_id", *c).collect()))
    assert same(bucket, limits.token_bucket(table, "k", "ms", "event_id", 5, 30), "allowed", "retry_ms")
    assert same(window, limits.sliding_limit(table, "k", "ms", "event_id", 4, 9000), "allowed")
    assert 0 < window.filter("allowed").count() < 240


def test_a_table_is_a_file_or_a_folder(spark, tmp_path):
    from larkspan.streaming import windows

    rows = spark.createDataFrame([(i, i) for i in range(20)], "event_id long, ms long")
    rows.repartition(4).write.parquet(f"{tmp_path}/parts/events.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/one")
    next((tmp_path / "one").glob("part-*.parquet")).rename(tmp_path / "one/events.parquet")
    rows.limit(0).write.parquet(f"{tmp_path}/none/events.parquet")
    for folder, expected in (("parts", 20), ("one", 20), ("none", 0)):
        got, _ = running.run(windows.read_stream(spark, f"{tmp_path}/{folder}", "events"), f"file://{tmp_path}/run-{folder}")
        assert got.count() == expected
