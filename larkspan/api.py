"""The twelve operations as batch functions: a table of requests in, a table of results out.

Requests carry the scope columns where a store is asked. An `Engine` holds the stores' tables; operations that change a
store return the new table, which the caller writes.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions import text, urls
from larkspan.functions.entities import entities
from larkspan.functions.html import article_of
from larkspan.operators import answers, cache, changes, graph, index, limits, notes, search
from larkspan.operators.inverted import InvertedIndex
from larkspan.operators.ranking import first_per, top_k_per
from larkspan.operators.rerank import hash_embedding
from larkspan.schemas import SCOPE

#: What each operation needs, in the order of the list of operations; fixed values.
PERMISSIONS = {
    "web_search": "search:read", "research": "knowledge:write", "fetch_content": "content:read", "server_status": "status:read", "ingest_document": "knowledge:write",
    "index_url": "knowledge:write", "search_index": "knowledge:read", "list_index": "knowledge:read", "remember": "memory:write", "recall": "memory:read",
    "forget": "memory:write", "find_related": "knowledge:read",
}

_DATE = re.compile(r"\d{4}-\d{2}-\d{2}")


def check(name: str, value: int, low: int, high: int) -> int:
    if not isinstance(value, int) or isinstance(value, bool) or not low <= value <= high:
        raise ValueError(f"{name} is a whole number from {low} to {high}")
    return value


def check_date(name: str, value: str | None) -> str | None:
    if value is not None and not _DATE.fullmatch(value):
        raise ValueError(f"{name} is a date like 2024-01-31")
    return value


@dataclass
class Engine:
    """docs, chunks, vectors, entities, links, graph_docs, notes, pages (scope, url, content, category, ts), search_cache and
    results (query_id, provider, provider_ord, pos, url, title[, variant, published_at]), as far as the operations used
    need them. Requests carry the scope columns, and see rows of their own scope alone."""

    tables: dict[str, DataFrame]
    providers: list[str] = field(default_factory=lambda: ["duckduckgo"])
    #: A stored index of the chunks, see `lexical_texts`; ingesting extends it, and searches read it instead of the chunks.
    lexical: InvertedIndex | None = None

    def _table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise ValueError(f"the engine has no table {name}")
        return self.tables[name]

    def web_search(
        self, requests: DataFrame, max_results: int = 5, expand_query: bool = False, from_date: str | None = None, to_date: str | None = None, strategy: str = "fallback", now: Column | None = None
    ) -> DataFrame:
        """(query_id, rank, key, url, title, sources, score, cache) of (query_id, query, domain, scope), see `search.web_search`.

        With `now` and a table search_cache, requests that it answers aren't asked again; `cache` says hit or miss.
        """
        k = check("max_results", max_results, 1, 10)
        since, until = check_date("from_date", from_date), check_date("to_date", to_date)
        if now is None or "search_cache" not in self.tables:
            found = search.web_search(requests, self._table("results"), self.providers, k, expand_query, since, until, strategy)
            return found.withColumn("cache", F.lit("miss"))
        namespaced = search.namespaced(requests, strategy, expand_query, since, until, self.providers)
        kept = search.cached_results(namespaced, self._table("search_cache"), now, k, since, until)
        left = requests.join(kept.select("query_id").distinct(), "query_id", "left_anti")
        found = search.web_search(left, self._table("results"), self.providers, k, expand_query, since, until, strategy)
        return found.withColumn("cache", F.lit("miss")).unionByName(kept.withColumn("cache", F.lit("hit")))

    def cache_results(self, requests: DataFrame, found: DataFrame, at: Column, expand_query: bool = False, from_date: str | None = None, to_date: str | None = None, strategy: str = "fallback") -> DataFrame:
        """The table search_cache after the results that `web_search` found are kept; requests without any are not."""
        namespaced = search.namespaced(requests, strategy, expand_query, from_date, to_date, self.providers)
        return cache.remember(self._table("search_cache"), search.cache_entries(namespaced, found.filter("cache = 'miss'"), at))

    def deep_search(self, requests: DataFrame, **options) -> DataFrame:
        """(query_id, answer, pages_fetched): an answer from the first two results' pages of the request's scope; without
        any page the answer is null and the results of `web_search` stand."""
        found = self.web_search(requests, **options)
        pages = search.read_pages(found.filter("rank <= 2"), requests, self._table("pages"))
        read = pages.withColumnRenamed("rank", "source")
        counted = read.groupBy("query_id").agg(F.count("*").alias("pages_fetched"))
        made = answers.answers(requests.select("query_id", F.col("query").alias("question")), read).join(counted, "query_id")
        return requests.select("query_id").join(made, "query_id", "left").select("query_id", "answer", F.coalesce("pages_fetched", F.lit(0)).alias("pages_fetched"))

    def fetch_content(self, requests: DataFrame, now: Column) -> DataFrame:
        """Cached pages of (scope, url) that may still be shown; urls of private hosts have none."""
        return cache.content(requests.filter(urls.public_address(F.col("url")) == "ok"), self._table("pages"), now)

    def _sources(self, questions: DataFrame, max_sources: int, index: bool, options: dict) -> DataFrame:
        k = check("max_sources", max_sources, 1, 5)
        found = self.web_search(questions, min(10, k + 2), **options).filter(F.col("rank") <= k)
        docs = self._table("docs")
        hits = self.search_index(questions, 3).select("query_id", "rank", "hit_id", *SCOPE)
        chunks = self._table("chunks").select(*SCOPE, F.col("chunk_id").alias("hit_id"), F.col("doc_id").alias("id"), F.col("text").alias("content"))
        local = hits.join(chunks, [*SCOPE, "hit_id"]).join(docs.select(*SCOPE, "id", F.col("source").alias("url"), "title"), [*SCOPE, "id"])
        return search.research_sources(questions, found, local, self._table("pages"), docs.select(*SCOPE, F.col("source").alias("url")), index)

    def research(self, questions: DataFrame, max_sources: int = 3, index: bool = True, **options) -> DataFrame:
        """(query_id, answer, sources) of (query_id, query, domain, scope): the best pages of the request's own scope, then
        what its index has, with citations; sources is an array of (source, origin, url, title, status).

        `options` are those of `web_search`. What `index` says would be indexed, `research_index` indexes.
        """
        sources = self._sources(questions, max_sources, index, options)
        made = answers.answers(questions.select("query_id", F.col("query").alias("question")), sources.filter("source IS NOT NULL"))
        listed = F.array_sort(F.collect_list(F.struct("place", "source", "origin", "url", "title", "status")))
        return made.join(sources.groupBy("query_id").agg(listed.alias("sources")), "query_id", "left")

    def research_index(self, questions: DataFrame, at: Column, max_sources: int = 3, **options) -> dict[str, DataFrame]:
        """The tables after `research` has indexed the pages it read that its scope didn't have."""
        new = self._sources(questions, max_sources, True, options).filter("status = 'indexed'")
        new = new.join(questions.select("query_id", *SCOPE), "query_id")
        once = first_per(new, [*SCOPE, "url"], ["query_id", "place"])
        return self.ingest_document(once.select(F.sha1(F.concat_ws("|", *SCOPE, "url")).alias("id"), F.col("url").alias("source"), "title", F.lit("research").alias("category"), "content", at.alias("ts"), *SCOPE))

    def ingest_document(self, documents: DataFrame) -> dict[str, DataFrame]:
        """The new docs, chunks, entities and links after (id, source, title, category, content, ts, scope) are ingested; with a
        table vectors also those of the chunks. A stored index of the chunks is extended at once."""
        docs, chunks = index.ingest(documents)
        said = docs.select(*SCOPE, F.col("id").alias("doc_id"), F.explode(entities(F.col("content"))).alias("e")).select(*SCOPE, "doc_id", "e.name", "e.n")
        own, links = graph.index_documents(self._table("entities"), self._table("links"), said)
        if self.lexical is not None:
            self.lexical.extend(self.lexical_texts(chunks, docs), ("source",))
        new = {"docs": self._table("docs").unionByName(docs.select(self._table("docs").columns)), "chunks": self._table("chunks").unionByName(chunks), "entities": own, "links": links}
        if "vectors" in self.tables:
            new["vectors"] = self._table("vectors").select("chunk_id", "embedding").unionByName(index.embed_chunks(chunks).select("chunk_id", "embedding"))
        return new

    @staticmethod
    def lexical_texts(chunks: DataFrame, docs: DataFrame) -> DataFrame:
        """(hit_id, text, grp, source) of chunks, as `InvertedIndex.extend` takes them."""
        own = chunks.select(F.col("chunk_id").alias("hit_id"), "text", F.to_json(F.array(*SCOPE)).alias("grp"), F.col("doc_id").alias("id"), *SCOPE)
        return own.join(docs.select(*SCOPE, "id", "source"), [*SCOPE, "id"], "left").select("hit_id", "text", "grp", "source")

    def index_url(self, requests: DataFrame, at: Column) -> dict[str, DataFrame]:
        """As `ingest_document`, of the main articles of cached pages (scope, url) that are not in the index."""
        known = self._table("docs").select(*SCOPE, F.col("source").alias("url"))
        pages = self._table("pages").join(requests.select(*SCOPE, "url").distinct(), [*SCOPE, "url"], "left_semi").join(known, [*SCOPE, "url"], "left_anti")
        read = pages.withColumn("a", article_of(F.col("content"))).filter("a IS NOT NULL")
        return self.ingest_document(read.select(F.sha1(F.concat_ws("|", *SCOPE, "url")).alias("id"), F.col("url").alias("source"), "a.title", "category", "a.content", at.alias("ts"), *SCOPE))

    def search_index(self, requests: DataFrame, max_results: int = 5, source: str | None = None, embed: Callable[[Column], Column] = hash_embedding) -> DataFrame:
        """(query_id, scope, hit_id, score, matched_by, rank) of (query_id, query, scope): chunks of the request's scope, of
        one source if given. Keyword hits and, where the engine has a table vectors (chunk_id, embedding) made by `embed`,
        nearest vectors are fused; without it keyword hits stand. The statistics are those of all chunks. With a stored index
        no text is read."""
        k = check("max_results", max_results, 1, 20)
        scope = F.to_json(F.array(*SCOPE))
        asked = requests.select("query_id", text.rewrite_query(F.col("query")).alias("text"), scope.alias("grp"))
        where = None if source is None else F.col("source") == source
        chunks = self.lexical.docs().select("hit_id", "grp", "source") if self.lexical is not None else self.lexical_texts(self._table("chunks"), self._table("docs"))
        texts = chunks if self.lexical is None else self.lexical
        if "vectors" in self.tables:
            vectors = self._table("vectors").withColumnRenamed("chunk_id", "hit_id").join(chunks.drop("text"), "hit_id")
            found = index.hybrid(asked.withColumn("embedding", embed(F.col("text"))), texts, vectors, k, 3, where, True)
        else:
            found = index.keyword_hits(asked, texts, k, where, True).withColumn("matched_by", F.lit("keyword"))
        return found.join(requests.select("query_id", *SCOPE), "query_id").select("query_id", *SCOPE, "hit_id", "score", "matched_by", "rank")

    def list_index(self, limit: int = 50) -> DataFrame:
        """Documents of each scope without their contents, newest first."""
        return top_k_per(self._table("docs").drop("content"), list(SCOPE), [F.col("ts").desc(), "id"], check("limit", limit, 1, 200))

    def remember(self, new: DataFrame) -> DataFrame:
        """The notes with new ones, the newest of each scope."""
        return notes.evict(self._table("notes").unionByName(new))

    def recall(self, query: str | None = None, topic: str | None = None, session: str | None = None, limit: int = 10) -> DataFrame:
        """Notes of every scope for one request, see `recall_all` for many."""
        where = F.lit(True)
        for name, value in (("topic", topic), ("session", session)):
            where = where & (F.col(name) == value) if value is not None else where
        limit = check("limit", limit, 1, 50)
        return notes.search(self._table("notes"), query, limit, where) if query else notes.listed(self._table("notes"), limit, where)

    def recall_all(self, requests: DataFrame, limit: int = 10) -> DataFrame:
        """(request_id, rank, score and the note's columns) of (request_id, query, topic, session, scope): for each request
        the notes of its scope, topic and session that contain most of its words, or the newest where it has no query."""
        return notes.recalled(requests, self._table("notes"), check("limit", limit, 1, 50))

    def forget(self, gone: DataFrame) -> DataFrame:
        """The notes without those of (scope, id)."""
        return changes.delete_by(self._table("notes"), gone, [*SCOPE, "id"])

    def find_related(self, names: DataFrame, limit: int = 10) -> DataFrame:
        """(scope, asked, name, cooccurrence, rank) of (scope, asked)."""
        found = graph.related(self._table("entities"), self._table("links"), names)
        return top_k_per(found, [*SCOPE, "asked"], [F.col("cooccurrence").desc(), "name"], check("limit", limit, 1, 20))

    def find_documents(self, names: DataFrame, limit: int = 10) -> DataFrame:
        """(scope, asked, doc_id, source, title, count, ts, rank): documents that mention each name asked for in its scope."""
        docs = self._table("graph_docs") if "graph_docs" in self.tables else self._table("docs").select(*SCOPE, F.col("id").alias("doc_id"), "source", "title", "ts")
        found = graph.documents_of(self._table("entities"), self._table("links"), docs, names)
        return top_k_per(found, [*SCOPE, "asked"], [F.col("count").desc(), F.col("ts").desc(), "doc_id"], check("limit", limit, 1, 20))

    def server_status(self, attempts: DataFrame, traces: DataFrame | None = None) -> dict[str, DataFrame]:
        """providers: health of each of (provider, ts, event_id, ok), last five attempts; stores: rows a scope of each table
        the engine has; notes: sessions a scope; searches: the ten newest of (ts, trace_id, ..) if traces are given."""
        out = {"providers": limits.health(attempts, "provider", ["ts", "event_id"], "ok")}
        stores = [n for n in ("docs", "chunks", "notes", "entities", "pages", "search_cache") if n in self.tables]
        counts = [self.tables[n].groupBy(*SCOPE).agg(F.count("*").alias("n")).select(F.lit(n).alias("store"), *SCOPE, "n") for n in stores]
        if counts:
            out["stores"] = reduce(DataFrame.unionByName, counts)
        if "notes" in self.tables:
            out["notes"] = self.tables["notes"].groupBy(*SCOPE).agg(F.count("*").alias("n"), F.countDistinct("session").alias("sessions"))
        if traces is not None:
            out["searches"] = traces.orderBy(F.col("ts").desc(), "trace_id").limit(10)
        return out
