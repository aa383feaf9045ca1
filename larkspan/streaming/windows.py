"""Event-time streams: windows, late data, deduplication, counters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.tables import shared_root


def read_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a table, a file of that name or a folder of files; a bound on files a batch keeps
    back-pressure."""
    table = f"{folder}/{name}.parquet"
    place = spark._jvm.org.apache.hadoop.fs.Path(table)
    parts = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()
    reader = spark.readStream.schema(spark.read.parquet(table).schema).option("pathGlobFilter", "*.parquet" if parts else f"{name}.parquet")
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(table if parts else folder)


def _late(events: DataFrame, late: str | None) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else events


def tumbling(events: DataFrame, width: str, keys: list[str], late: str | None = None) -> DataFrame:
    rows = _late(events, late)
    return rows.groupBy(F.window("ts", width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, width: str, step: str, keys: list[str], late: str | None = None) -> DataFrame:
    rows = _late(events, late)
    return rows.groupBy(F.window("ts", width, step), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    rows = _late(events, late)
    return rows.groupBy(F.session_window("ts", gap), *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def deduplicated(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def counters(events: DataFrame, keys: list[str]) -> DataFrame:
    """Counts since the start, for complete or update mode."""
    return events.groupBy(*keys).agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "error").alias("errors"))


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there and return its result as a table, written to the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_root(spark)}/larkspan/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        # In complete mode each batch is the whole result, else what is new; a batch that runs again overwrites itself.
        batch.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/{number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{base}/out")
