"""Traces of requests from a stream of their stages: sessions that are over, and what came too late for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def traces(stages: DataFrame, keys: list[str], gap: str, late: str, at: str = "ts", duration: str = "duration_ms", status: str = "status") -> DataFrame:
    """(start, end, *keys, stages, failed, skipped, total_ms, first_error) of a stream of stages: a trace is what has no `gap` in
    time. A trace is emitted once, when the watermark (the latest time less `late`) has passed its end, gap included; a
    stage whose time the watermark has passed is dropped, and counted by the query's progress."""
    rows = stages.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    failed = F.col(status) == "error"
    sums = rows.groupBy(F.session_window("_at", gap).alias("_w"), *keys).agg(
        F.count("*").alias("stages"), F.count_if(failed).alias("failed"), F.count_if(F.col(status) == "skipped").alias("skipped"), F.sum(duration).alias("total_ms"), F.min(F.when(failed, F.col("_at"))).alias("first_error"),
    )
    return sums.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *keys, "stages", "failed", "skipped", "total_ms", "first_error")
