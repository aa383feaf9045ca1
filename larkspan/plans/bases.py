"""The engine's tables as views of the test tables; the same text serves Spark and the SQL that checks it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from larkspan.catalog import table

_MODE = "CASE WHEN {id} % 2 = 0 THEN 'local' ELSE 'hosted' END AS execution_mode"
_TENANT = "CASE WHEN {id} % 2 = 0 THEN 'local' ELSE concat('t', CAST({id} % 3 AS STRING)) END AS tenant_id"
_WORKSPACE = "CASE WHEN {id} % 2 = 0 THEN 'local' ELSE concat('w', CAST({id} % 5 AS STRING)) END AS workspace_id"


def _scope(column: str) -> str:
    return ", ".join(x.replace("{id}", column) for x in (_MODE, _TENANT, _WORKSPACE))


def scope_of(column: str) -> list[str]:
    """The scope columns that follow from an id, as SQL."""
    return [x.replace("{id}", column) for x in (_MODE, _TENANT, _WORKSPACE)]


def _listed(provider: str, ordinal: int, step: int) -> str:
    return (
        f"SELECT page_id % 40 AS query_id, '{provider}' AS provider, {ordinal} AS provider_ord, page_id, url, concat('Page ', CAST(page_id AS STRING)) AS title, "
        f"CAST(row_number() OVER (PARTITION BY page_id % 40 ORDER BY (page_id * {step}) % 997, page_id) AS INT) AS pos FROM {{pages}}"
    )


BASES = {
    "docs": f"SELECT doc_id, text AS content, source, lang AS category, 1700000000000 + doc_id * 3600000 AS ts, n_chars, {_scope('doc_id')} FROM {{documents}}",
    "notes": "SELECT concat(CAST(conv_id AS STRING), ':', CAST(turn AS STRING)) AS id, text, role AS topic, CAST(conv_id AS STRING) AS session, "
    f"1700000000000 + conv_id * 60000 + turn AS ts, conv_id * 1000 + turn AS seq, {_scope('conv_id')} FROM {{conversations}}",
    "attempts": "SELECT event_id, event_type AS provider, user_id, ts, CASE WHEN value > 60 THEN 'error' WHEN value > 45 THEN 'empty' WHEN value < 1 THEN 'backoff' ELSE 'ok' END AS status, "
    "CAST(event_id % 11 AS INT) AS result_count, value AS duration_ms, CASE WHEN value > 60 THEN concat('HTTP ', CAST(500 + event_id % 4 AS STRING)) END AS error FROM {events}",
    "results": " UNION ALL ".join(_listed(*x) for x in (("brave", 0, 7), ("google", 1, 31), ("bing", 2, 113))),
    "vectors": f"SELECT vec_id, embedding, label, CAST(label AS STRING) AS namespace, 1700000000000 + vec_id * 60000 AS ts, {_scope('vec_id')} FROM {{embeddings}}",
    "workspaces": "SELECT concat('w', CAST(n_nationkey AS STRING)) AS workspace_id, concat('t', CAST(n_regionkey AS STRING)) AS tenant_id, "
    "CASE WHEN n_nationkey % 7 = 3 THEN TIMESTAMP '2024-01-05 00:00:00' END AS disabled_at FROM {nation}",
    "memberships": "SELECT 'issuer' AS issuer, c_name AS principal_id, concat('w', CAST(c_nationkey AS STRING)) AS workspace_id, c_mktsegment AS segment, "
    "CASE WHEN c_acctbal < 0 THEN TIMESTAMP '2024-01-06 00:00:00' END AS revoked_at FROM {customer}",
    "cache": f"SELECT page_id, url, html AS content, CASE page_id % 4 WHEN 0 THEN 'docs' WHEN 1 THEN 'news' WHEN 2 THEN 'blog' ELSE 'general' END AS category, 1700000000000 + page_id * 3600000 AS ts, {_scope('page_id')} FROM {{pages}}",
    "usage": "SELECT event_id, concat('t', CAST(user_id % 4 AS STRING)) AS tenant_id, concat('w', CAST(user_id % 9 AS STRING)) AS workspace_id, event_type AS tool, ts, user_id, CASE WHEN value > 50 THEN 0 ELSE 1 END AS ok, value FROM {events}",
}


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = BASES[name]
    used = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def sub(name: str) -> str:
    """The view as a subquery for DuckDB, over tables of the same names."""
    return "(" + re.sub(r"\{(\w+)\}", r"\1", BASES[name]) + ")"
