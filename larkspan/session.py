"""Session construction with the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "larkspan", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session in UTC with adaptive execution on; `conf` overrides by dotted name (underscores allowed)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
