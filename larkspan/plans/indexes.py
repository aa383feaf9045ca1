"""Indexes of the test tables, built once in a session for all queries that search them."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from larkspan.catalog import table
from larkspan.operators.inverted import InvertedIndex, build_index
from larkspan.tables import shared_root

_BUILT: dict[tuple, str] = {}


def _files(spark: SparkSession, path: str) -> tuple:
    """Name, size and time of a table's files: what says that it is the table that was indexed."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in fs.listStatus(place))
    return tuple(found)


def documents_index(spark: SparkSession, sf_dir: str) -> InvertedIndex:
    """The index of the documents by their ids, with their source. The first search of a session builds it."""
    files = _files(spark, f"{sf_dir}/documents.parquet")
    key = (spark.sparkContext.applicationId, files)
    if key not in _BUILT:
        # A table of one file is read by few tasks, whose texts are dealt to all cores; it is small enough to be.
        spread = spark.sparkContext.defaultParallelism if len(files) == 1 else None
        folder = f"{shared_root(spark)}/larkspan/index-{uuid.uuid4().hex}"
        build_index(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("hit_id"), "text", "source"), folder, ("source",), spread)
        _BUILT[key] = folder
    return InvertedIndex(spark, _BUILT[key])
