"""Web search and research over recorded results and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspan.functions import dates, routing
from larkspan.functions.text import cache_namespace, expand_query, site_of
from larkspan.operators import cache, execution, fusion
from larkspan.operators.ranking import first_per, top_k_per, with_rank
from larkspan.operators.rerank import hash_embedding
from larkspan.schemas import SCOPE

STRATEGIES = ("fallback", "aggregate", "auto")


def asked_results(requests: DataFrame, results: DataFrame, expand: bool, year: int | None = None) -> DataFrame:
    """The recorded results that requests (query_id, query) ask for, with the number of the variant of the query, from 0:
    without `expand` those of the query itself. Results without a column `variant` are the query's own."""
    rows = results if "variant" in results.columns else results.withColumn("variant", F.lit(0))
    if not expand:
        return rows.join(requests.select("query_id"), "query_id", "left_semi").filter("variant = 0")
    variants = expand_query(F.col("query"), 2, routing.intent(F.col("query")), year)
    wanted = requests.select("query_id", F.posexplode(variants).alias("variant", "_text")).drop("_text")
    return rows.join(wanted, ["query_id", "variant"], "left_semi")


def executed(requests: DataFrame, results: DataFrame, providers: list[str], strategy: str, repeats: bool = False) -> DataFrame:
    """(query_id, key, url, title, sources, provider_ranks, score) of one list of results for each request: of the first
    provider that has any, of all fused, or as the plan for the query's intent has it."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {', '.join(STRATEGIES)}")
    if strategy == "auto":
        return execution.planned(requests, results, providers, repeats)
    rows = execution.filtered(results.filter(F.col("provider").isin(*providers)), requests, repeats)
    return fusion.fuse_providers(rows if strategy == "aggregate" else execution.fallback(rows))


def web_search(requests: DataFrame, results: DataFrame, providers: list[str], k: int, expand: bool = False, since: str | None = None, until: str | None = None, strategy: str = "fallback", repeats: bool = False) -> DataFrame:
    """(query_id, rank, key, url, title, sources, score) of requests (query_id, query, domain): dates and domain come first,
    each variant of the query is executed by itself, and the variants' lists are fused by rank. With `repeats`, a url that
    a list has twice keeps both places."""
    rows = asked_results(requests, results, expand)
    if since or until:
        published = F.col("published_at") if "published_at" in rows.columns else F.lit(None).cast("string")
        rows = rows.filter(dates.within(published, since, until))
    if not expand:
        found = executed(requests, rows.drop("variant"), providers, strategy, repeats)
    else:
        # A variant of a query is a request of its own.
        own = F.struct("query_id", "variant")
        each = requests.join(rows.select("query_id", "variant").distinct(), "query_id").withColumn("query_id", own).drop("variant")
        lists = executed(each, rows.withColumn("query_id", own).drop("variant"), providers, strategy, repeats)
        lists = with_rank(lists, ["query_id"], [F.col("score").desc(), "key"], "pos")
        titled = first_per(lists.select("query_id.query_id", "query_id.variant", "key", "title", "pos"), ["query_id", "key"], ["variant", "pos"])
        fused = fusion.fuse_variants(lists.select("query_id.query_id", "query_id.variant", "pos", "url", "sources", "provider_ranks"))
        found = fused.join(titled.select("query_id", "key", "title"), ["query_id", "key"])
    ranked = top_k_per(found.withColumn("score", F.round("score", 9)), ["query_id"], [F.col("score").desc(), "key"], k)
    return ranked.select("query_id", "rank", "key", "url", "title", "sources", "score")


def namespaced(requests: DataFrame, strategy: str, expand: bool, since: str | None, until: str | None, providers: list[str]) -> DataFrame:
    """(query_id, scope, query, namespace, grp): the cache's key of each request. Filters are exact parts of it."""
    domain = F.lower(F.coalesce("domain", site_of(F.col("query")), F.lit("")))
    plain = (domain == "") & F.lit(not (since or until))
    filters = F.when(plain, F.array().cast("array<string>")).otherwise(F.array(domain, F.lit(since or ""), F.lit(until or "")))
    kind = routing.intent(F.col("query"))
    space = cache_namespace(F.lit(strategy), kind, routing.plan(kind, F.array(*map(F.lit, providers)))["primary"] if strategy == "auto" else F.array().cast("array<string>"), F.lit(expand), filters)
    named = requests.select("query_id", *SCOPE, "query", space.alias("namespace"))
    return named.withColumn("grp", F.to_json(F.array(*SCOPE, "namespace")))


def cached_results(asked: DataFrame, entries: DataFrame, now: Column, k: int, since: str | None, until: str | None) -> DataFrame:
    """What the cache has for requests, in the form of `web_search`; its entries hold arrays of results."""
    own = entries.withColumn("grp", F.to_json(F.array(*SCOPE, "namespace"))).withColumnRenamed("entry_id", "hit_id")
    hits = cache.cached(asked.withColumn("embedding", hash_embedding(F.col("query"))), own, now)
    rows = hits.join(own.select("hit_id", "results"), "hit_id").select("query_id", F.posexplode("results").alias("pos", "r"))
    rows = rows.filter(dates.within(F.col("r.published_at"), since, until)).select("query_id", "pos", F.col("r.url").alias("key"), "r.url", "r.title", F.array("r.source").alias("sources"), (1.0 / (fusion.K + 1 + F.col("pos"))).alias("score"))
    return top_k_per(rows, ["query_id"], ["pos"], k).select("query_id", "rank", "key", "url", "title", "sources", "score")


def cache_entries(asked: DataFrame, found: DataFrame, at: Column, ttl_ms: int = 3_600_000) -> DataFrame:
    """Entries of the cache for requests that found something."""
    result = F.struct("title", "url", F.lit("").alias("snippet"), F.coalesce(F.get("sources", F.lit(0)), F.lit("")).alias("source"), F.lit(None).cast("string").alias("published_at"))
    lists = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", result.alias("r")))).alias("l"))
    made = asked.join(lists, "query_id").withColumn("results", F.transform("l", lambda x: x["r"]))
    return made.select(*SCOPE, F.sha1(F.concat_ws("|", "grp", F.lower(F.trim("query")))).alias("entry_id"), "query", "namespace", F.lit(ttl_ms).cast("long").alias("ttl_ms"), at.cast("long").alias("ts"), hash_embedding(F.col("query")).cast("array<float>").alias("embedding"), "results")


def read_pages(found: DataFrame, requests: DataFrame, pages: DataFrame) -> DataFrame:
    """(query_id, rank, url, title, content): the newest page of each result that the request's own scope has."""
    newest = first_per(pages.select(*SCOPE, "url", "content", "ts"), [*SCOPE, "url"], [F.col("ts").desc(), "content"])
    scoped = found.join(requests.select("query_id", *SCOPE), "query_id")
    return scoped.join(newest.drop("ts"), [*SCOPE, "url"]).select("query_id", "rank", "url", "title", "content")


def research_sources(questions: DataFrame, found: DataFrame, local: DataFrame, pages: DataFrame, indexed: DataFrame, index: bool) -> DataFrame:
    """(query_id, place, source, origin, url, title, status, content): the results found (query_id, rank, url, title) that
    could be read or not, then the hits of the index (query_id, rank, url, title, content) that aren't among them, each url
    once. source numbers what has a content, place all. indexed: (scope, url) of what the index has."""
    read = read_pages(found, questions, pages).select("query_id", "url", "content")
    scoped = found.join(questions.select("query_id", *SCOPE), "query_id").join(indexed.select(*SCOPE, "url").distinct().withColumn("_known", F.lit(True)), [*SCOPE, "url"], "left")
    web = scoped.join(read, ["query_id", "url"], "left")
    status = F.when(F.col("content").isNull(), "fetch_failed").when(F.col("_known"), "already_indexed").otherwise("indexed" if index else "not_indexed")
    web = web.select("query_id", F.lit("web").alias("origin"), "rank", "url", "title", status.alias("status"), "content")
    rest = first_per(local, ["query_id", "url"], ["rank"]).join(found.select("query_id", "url"), ["query_id", "url"], "left_anti")
    rest = rest.select("query_id", F.lit("local").alias("origin"), "rank", "url", "title", F.lit("already_indexed").alias("status"), "content")
    both = with_rank(web.unionByName(rest), ["query_id"], [F.col("origin").desc(), "rank"], "place")
    so_far = Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    number = F.when(F.col("content").isNotNull(), F.col("place") - F.sum(F.col("content").isNull().cast("int")).over(so_far))
    return both.withColumn("source", number.cast("int")).select("query_id", "place", "source", "origin", "url", "title", "status", "content")

