"""Schemas of the engine's tables as DDL text, and additive evolution of older files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCOPE = ("execution_mode", "tenant_id", "workspace_id")
LOCAL = "local"

_SCOPE_DDL = "execution_mode string, tenant_id string, workspace_id string"

DOCS = f"id string, source string, title string, category string, content string, chunk_count int, ts long, {_SCOPE_DDL}"
CHUNKS = f"chunk_id string, doc_id string, chunk_index int, text string, ts long, {_SCOPE_DDL}"
VECTORS = "chunk_id string, embedding array<float>"
ENTITIES = f"{_SCOPE_DDL}, entity_id string, name string, mention_count long"
GRAPH_DOCS = f"{_SCOPE_DDL}, doc_id string, source string, title string, ts long"
LINKS = f"{_SCOPE_DDL}, doc_id string, entity_id string, count int"
NOTES = f"id string, text string, topic string, tags array<string>, session string, ts long, {_SCOPE_DDL}"
CONTENT_CACHE = f"{_SCOPE_DDL}, url string, content string, category string, ts long, published_at string"
RESULT = "struct<title:string,url:string,snippet:string,source:string,published_at:string>"
SEARCH_CACHE = f"{_SCOPE_DDL}, entry_id string, query string, namespace string, ttl_ms long, ts long, embedding array<float>, results array<{RESULT}>"
WORKSPACES = "workspace_id string, tenant_id string, disabled_at timestamp"
MEMBERSHIPS = "issuer string, principal_id string, workspace_id string, permissions array<string>, revoked_at timestamp"
AUDIT = "event_id long, occurred_at timestamp, actor string, entity_type string, action string, before string, after string"
ATTEMPTS = "provider string, status string, result_count int, duration_ms double, error string"

TABLES = {
    "knowledge_docs": DOCS, "knowledge_chunks": CHUNKS, "knowledge_vectors": VECTORS, "graph_entities": ENTITIES, "graph_docs": GRAPH_DOCS,
    "graph_links": LINKS, "session_notes": NOTES, "content_cache": CONTENT_CACHE, "search_cache": SEARCH_CACHE, "workspaces": WORKSPACES,
    "memberships": MEMBERSHIPS, "membership_audit": AUDIT, "provider_attempts": ATTEMPTS,
}


def fields(ddl: str) -> list[tuple[str, str]]:
    """(name, type) of a DDL text; commas within <> belong to a type."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(ddl[start:i].strip())
            start = i + 1
    return [tuple(p.split(" ", 1)) for p in parts]


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """The columns of `ddl` in its order: what is missing comes in as null, or as the local scope, what is there is cast."""
    have = {c.lower() for c in df.columns}
    out = []
    for name, kind in fields(ddl):
        if name.lower() in have:
            out.append(F.col(name).cast(kind).alias(name))
        else:
            out.append(F.lit(LOCAL if name in SCOPE else None).cast(kind).alias(name))
    return df.select(*out)


def in_scope(df: DataFrame, execution_mode: str, tenant_id: str, workspace_id: str) -> DataFrame:
    """Rows of one scope. Filter before any ranking or limit: a limit that comes first would see other scopes' rows."""
    return df.filter((F.col("execution_mode") == execution_mode) & (F.col("tenant_id") == tenant_id) & (F.col("workspace_id") == workspace_id))
