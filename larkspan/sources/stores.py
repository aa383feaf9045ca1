"""Stores of documents laid out by scope: partitioned by it, and bucketed by document.

A request reads the partitions of its own scope alone, and tables that are saved by document meet without an exchange. A
scope with a third of all rows is spread over the buckets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions.text import entity_id
from larkspan.schemas import SCOPE
from larkspan.tables import shared_root


class ScopedStores:
    """Tables under a folder on shared storage, of one number of buckets, so that all of them meet bucket by bucket."""

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int = 16):
        self.spark, self.buckets = spark, buckets
        self.folder = folder or f"{shared_root(spark)}/larkspan/stores-{uuid.uuid4().hex}"
        self.prefix = f"larkspan_{uuid.uuid4().hex}_"

    def save(self, name: str, rows: DataFrame, key: str = "doc_id", mode: str = "overwrite") -> ScopedStores:
        """Write, or with mode append add, rows with the scope columns and `key`; a null scope is a partition of its own, a null
        key meets nothing. Each task writes one bucket, so a scope has as many files as buckets."""
        spread = rows.repartition(self.buckets, key)
        writer = spread.write.mode(mode).format("parquet").partitionBy(*SCOPE).bucketBy(self.buckets, key).sortBy(key)
        writer.option("path", f"{self.folder}/{name}").saveAsTable(self.prefix + name)
        return self

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self.prefix + name)

    def of(self, execution_mode: str, tenant_id: str, workspace_id: str) -> Scope:
        return Scope(self, dict(zip(SCOPE, (execution_mode, tenant_id, workspace_id), strict=True)))


class Scope:
    """What a request of one scope sees of the stores."""

    def __init__(self, stores: ScopedStores, values: dict[str, str]):
        self.stores, self.values = stores, values

    def table(self, name: str) -> DataFrame:
        rows = self.stores.table(name)
        for column, value in self.values.items():
            rows = rows.filter(F.col(column) == value)
        return rows.drop(*SCOPE)

    def documents_of(self, names: DataFrame) -> DataFrame:
        """(asked, doc_id, count and the documents' columns) for names (asked), whatever their case, by links and docs."""
        wanted = names.select("asked", entity_id(F.col("asked")).alias("entity_id"))
        return self.table("docs").join(self.table("links"), "doc_id").join(wanted, "entity_id").drop("entity_id")

    def without(self, ids: DataFrame, *names: str) -> dict[str, DataFrame]:
        """What is left of the tables when documents (doc_id) go, with all that hangs on them."""
        gone = ids.select("doc_id").distinct().repartition(self.stores.buckets, "doc_id")
        return {name: self.table(name).join(gone, "doc_id", "left_anti") for name in names}

    def chunks_of(self, where: str) -> DataFrame:
        """Chunks of documents that meet a condition, with their documents' columns."""
        return self.table("docs").filter(where).join(self.table("chunks"), "doc_id")
