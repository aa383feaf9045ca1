"""The semantic result cache and the content cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions.routing import content_ttl
from larkspan.operators.changes import upsert
from larkspan.operators.nearest import nearest
from larkspan.operators.ranking import first_per
from larkspan.schemas import SCOPE

HOUR = 3_600_000


def cached(requests: DataFrame, entries: DataFrame, now: Column, threshold: float = 0.75, looked_at: int = 5) -> DataFrame:
    """(query_id, hit_id, sim): for each request the nearest entry of its namespace that is like enough and not too old.

    requests: (query_id, embedding, grp), entries: (hit_id, embedding, grp, ts, ttl_ms). The nearest five are looked at
    and no more: likeness and age are tested after that.
    """
    found = nearest(requests, entries.select("hit_id", "embedding", "grp"), looked_at, same_group=True)
    good = found.join(entries.select("hit_id", "ts", "ttl_ms"), "hit_id").filter((F.col("sim") >= threshold) & (now - F.col("ts") <= F.coalesce("ttl_ms", F.lit(HOUR))))
    return first_per(good, ["query_id"], ["rank"]).select("query_id", "hit_id", "sim")


def remember(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Entries after new ones are kept: of one scope, namespace and query (whatever its case) the newest stays."""
    key = lambda df: df.withColumn("entry_key", F.concat_ws("|", "namespace", F.lower(F.trim("query"))))
    return upsert(key(entries), key(new), [*SCOPE, "entry_key"], "ts").drop("entry_key")


def content(requests: DataFrame, pages: DataFrame, now: Column) -> DataFrame:
    """Pages of the requested (scope, url) that are not too old for their category."""
    keys = [*SCOPE, "url"]
    return pages.join(requests.select(*keys).distinct(), keys, "left_semi").filter(now - F.col("ts") <= content_ttl(F.col("category")))
