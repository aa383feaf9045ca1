"""Stores laid out by scope: what plans read, and that tables meet without an exchange."""

from __future__ import annotations

import pytest

from larkspan.functions.text import entity_id
from larkspan.schemas import SCOPE
from larkspan.sources.stores import ScopedStores
from pyspark.sql import functions as F

S = "execution_mode string, tenant_id string, workspace_id string"


@pytest.fixture(scope="module")
def stores(spark):
    scope = lambda i: ("hosted", f"t{i % 2}", f"w{i % 3}")
    docs = spark.createDataFrame([(f"d{i}", f"src{i % 4}", *scope(i)) for i in range(120)] + [(None, "s", *scope(0)), ("x", "s", None, None, None)], f"doc_id string, source string, {S}")
    chunks = spark.createDataFrame([(f"d{i}", n, *scope(i)) for i in range(120) for n in range(i % 5)], f"doc_id string, n int, {S}")
    links = spark.createDataFrame([(f"d{i}", name, i, *scope(i)) for i in range(120) for name in ("redis", "kafka")[: i % 3]], f"doc_id string, name string, count int, {S}")
    return ScopedStores(spark, buckets=4).save("docs", docs).save("chunks", chunks).save("links", links.withColumn("entity_id", entity_id(F.col("name"))).drop("name"))


def joined(frame):
    """The physical plan with no side small enough to be sent."""
    conf = frame.sparkSession.conf
    had = conf.get("spark.sql.autoBroadcastJoinThreshold")
    conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return frame._jdf.queryExecution().executedPlan().toString()
    finally:
        conf.set("spark.sql.autoBroadcastJoinThreshold", had)


def test_a_scope_reads_its_partitions_alone(stores):
    rows = stores.of("hosted", "t1", "w2").table("docs")
    assert {r.doc_id for r in rows.collect()} == {f"d{i}" for i in range(120) if i % 2 == 1 and i % 3 == 2} and not set(SCOPE) & set(rows.columns)
    plan = joined(rows)
    assert "PartitionFilters: [isnotnull(execution_mode" in plan and "PushedFilters: []" in plan
    assert len(rows.inputFiles()) <= 4 < len(stores.table("docs").inputFiles())


def test_documents_and_chunks_meet_without_an_exchange(stores):
    own = stores.of("hosted", "t1", "w2")
    rows = own.chunks_of("source = 'src1'")
    plan = joined(rows)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert sorted((r.doc_id, r.n) for r in rows.collect()) == sorted((f"d{i}", n) for i in range(120) if i % 2 == 1 and i % 3 == 2 and i % 4 == 1 for n in range(i % 5))


def test_documents_of_an_entity(spark, stores):
    names = spark.createDataFrame([("Redis",), ("nobody",)], "asked string")
    rows = stores.of("hosted", "t0", "w1").documents_of(names)
    first = joined(stores.of("hosted", "t0", "w1").table("docs").join(stores.of("hosted", "t0", "w1").table("links"), "doc_id"))
    assert "Exchange" not in first
    assert sorted((r.asked, r.doc_id, r["count"]) for r in rows.collect()) == sorted(("Redis", f"d{i}", i) for i in range(120) if i % 2 == 0 and i % 3 == 1)


def test_a_cascade_moves_the_ids_alone(spark, stores):
    ids = spark.createDataFrame([(f"d{i}",) for i in range(0, 120, 5)], "doc_id string")
    own = stores.of("hosted", "t1", "w0")
    left = own.without(ids, "docs", "chunks")
    plan = joined(left["chunks"])
    assert plan.count("Exchange hashpartitioning(doc_id") <= 2 and "SinglePartition" not in plan
    scan = plan[plan.index("FileScan") - 400 : plan.index("FileScan")]
    assert "Exchange" not in scan
    mine = [i for i in range(120) if i % 2 == 1 and i % 3 == 0]
    assert {r.doc_id for r in left["docs"].collect()} == {f"d{i}" for i in mine if i % 5}
    assert left["chunks"].count() == sum(i % 5 for i in mine if i % 5)


def test_rows_are_added_and_unknown_scopes_are_empty(spark, stores):
    stores.save("more", spark.createDataFrame([("a", 1, "hosted", "t", "w")], f"doc_id string, v int, {S}"))
    stores.save("more", spark.createDataFrame([("a", 2, "hosted", "t", "w"), ("b", 3, "hosted", "u", "w")], f"doc_id string, v int, {S}"), mode="append")
    assert sorted(r.v for r in stores.of("hosted", "t", "w").table("more").collect()) == [1, 2]
    assert stores.of("hosted", "none", "w").table("docs").collect() == []
