"""Reciprocal-rank fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.functions import urls
from larkspan.operators.ranking import first_per

K = 60


def fuse_providers(results: DataFrame, k: int = K) -> DataFrame:
    """(query_id, key, url, title, sources, provider_ranks, score) of rows (query_id, provider, provider_ord, pos, url, title).

    A list's entries for one page count once, at the best place, and the places of what follows stay as they were. The
    page is shown as the first provider that has it shows it; providers are named in that order.
    """
    keyed = results.filter(F.coalesce("url", F.lit("")) != "").withColumn("key", urls.normalize(F.col("url"))).filter("key <> ''")
    best = first_per(keyed, ["query_id", "provider", "key"], ["provider_ord", "pos"])
    shown = F.struct("provider_ord", "pos", "url", "title")
    listed = F.array_sort(F.collect_list(F.struct("provider_ord", "provider", "pos")))
    fused = best.groupBy("query_id", "key").agg(F.min(shown).alias("shown"), listed.alias("listed"), F.sum(1.0 / (k + F.col("pos"))).alias("score"))
    return fused.select(
        "query_id", "key", "shown.url", "shown.title", F.transform("listed", lambda x: x["provider"]).alias("sources"),
        F.map_from_entries(F.transform("listed", lambda x: F.struct(x["provider"], x["pos"]))).alias("provider_ranks"), "score",
    )


def fuse_variants(lists: DataFrame, k: int = K) -> DataFrame:
    """(query_id, key, url, sources, provider_ranks, score) of rows (query_id, variant, pos, url, sources, provider_ranks).

    The place in each variant's list counts; providers are joined, and of two places a provider gave the better stays.
    """
    keyed = lists.withColumn("key", urls.normalize(F.col("url")))
    best = first_per(keyed, ["query_id", "variant", "key"], ["pos"])
    ranks = best.select("query_id", "key", F.explode("provider_ranks").alias("provider", "place")).groupBy("query_id", "key", "provider").agg(F.min("place").alias("place"))
    ranks = ranks.groupBy("query_id", "key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("provider", "place")))).alias("provider_ranks"))
    fused = best.groupBy("query_id", "key").agg(
        F.min(F.struct("variant", "pos", "url")).alias("shown"), F.array_sort(F.collect_list(F.struct("variant", "pos", "sources"))).alias("listed"), F.sum(1.0 / (k + F.col("pos"))).alias("score")
    )
    named = F.array_distinct(F.flatten(F.transform("listed", lambda x: x["sources"])))
    return fused.join(ranks, ["query_id", "key"], "left").select("query_id", "key", "shown.url", named.alias("sources"), "provider_ranks", "score")


def fuse_hits(keyword: DataFrame, vector: DataFrame, k: int = K) -> DataFrame:
    """(query_id, hit_id, score, matched_by) of two ranked lists (query_id, hit_id, rank)."""
    both = keyword.select("query_id", "hit_id", "rank", F.lit("keyword").alias("kind")).unionByName(vector.select("query_id", "hit_id", "rank", F.lit("vector").alias("kind")))
    kinds = F.array_sort(F.collect_set("kind"))
    return both.groupBy("query_id", "hit_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.when(F.size(kinds) > 1, "hybrid").otherwise(kinds[0]).alias("matched_by"))
