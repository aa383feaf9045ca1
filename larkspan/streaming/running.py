"""Streams that are run, stopped and run again: their state, and results of which each batch counts once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """State in maps and with timers needs this store; what the session had comes back when the stream has begun."""
    had = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if had is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, had)


def write_batches(folder: str, parts: dict[str, Callable[[DataFrame], DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A writer for foreachBatch: of each batch, each part under <folder>/<name>/batch=<number>. A batch that runs again after
    a loss has the same number and the same input, and replaces what it wrote before."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for name, part in parts.items():
                part(batch).write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        finally:
            batch.unpersist()

    return write


def start(stream: DataFrame, folder: str, write: Callable[[DataFrame, int], None], mode: str = "append", every: str | None = None) -> StreamingQuery:
    """Start, or go on with, a stream whose state is in <folder>/state: over all that is there, or every so often."""
    with keyed_state(stream.sparkSession):
        writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state")
        return (writer.trigger(processingTime=every) if every is not None else writer.trigger(availableNow=True)).start()


def run(stream: DataFrame, folder: str, mode: str = "append") -> tuple[DataFrame, int]:
    """(all rows so far, rows that came too late in this run) of a stream that is run to the end of what is there. Without any
    batch there are no rows."""
    spark = stream.sparkSession
    out = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/out")
    out.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(out)
    query = start(stream, folder, write_batches(folder, {"out": lambda batch: batch}), mode)
    query.awaitTermination()
    late = sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out"), late
