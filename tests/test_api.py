from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from larkspan.api import PERMISSIONS, Engine, check, check_date
from larkspan.functions.entities import extract

S = "execution_mode string, tenant_id string, workspace_id string"
HERE = ("local", "local", "local")


@pytest.fixture(scope="module")
def engine(spark):
    make = spark.createDataFrame
    page = "<html><title>T</title><body><article>" + "<p>React Native works with Redis here.</p>" * 12 + "</article></body></html>"
    return Engine({
        "docs": make([], f"id string, source string, title string, category string, content string, chunk_count int, ts long, {S}"),
        "chunks": make([("d:0", "d", 0, "postgres pooling guide", 1, *HERE), ("e:0", "e", 0, "postgres pooling guide", 1, "hosted", "t", "w")], f"chunk_id string, doc_id string, chunk_index int, text string, ts long, {S}"),
        "entities": make([], f"{S}, entity_id string, name string, mention_count long"),
        "links": make([], f"{S}, doc_id string, entity_id string, count int"),
        "notes": make([("n1", "a note", "t", "s", 1, 1, *HERE)], f"id string, text string, topic string, session string, ts long, seq long, {S}"),
        "pages": make([(*HERE, "https://a.org/x", page, "docs", 10)], f"{S}, url string, content string, category string, ts long"),
        "results": make([(1, "duckduckgo", 0, 1, "https://a.org/x", "A"), (1, "duckduckgo", 0, 2, "https://b.org/", "B")], "query_id long, provider string, provider_ord int, pos int, url string, title string"),
    })


def test_operations(spark, engine):
    asked = spark.createDataFrame([(1, "redis", None, *HERE)], f"query_id long, query string, domain string, {S}")
    assert [r.url for r in engine.web_search(asked).orderBy("rank").collect()] == ["https://a.org/x", "https://b.org/"]
    assert "Source 1: https://a.org/x" in engine.research(asked).first().answer
    urls = spark.createDataFrame([(*HERE, "https://a.org/x"), (*HERE, "http://127.0.0.1/")], f"{S}, url string")
    assert engine.fetch_content(urls, F.lit(20)).count() == 1
    after = engine.index_url(urls, F.lit(5).cast("long"))
    assert after["docs"].first().title == "T" and {r.name for r in after["entities"].collect()} == {n for n, _ in extract(after["docs"].first().content)}
    found = spark.createDataFrame([(2, "postgres pool", None, *HERE)], f"query_id long, query string, domain string, {S}")
    assert [r.hit_id for r in engine.search_index(found).collect()] == ["d:0"]
    more = spark.createDataFrame([("n2", "redis note", "t", "s", 2, 2, *HERE)], engine.tables["notes"].schema)
    engine.tables["notes"] = engine.remember(more)
    assert [r.id for r in engine.recall("REDIS").collect()] == ["n2"] and engine.recall(topic="t").count() == 2
    assert [r.id for r in engine.forget(more).collect()] == ["n1"]
    own = Engine(engine.tables | after)
    names = spark.createDataFrame([(*HERE, "redis")], f"{S}, asked string")
    assert "React Native" in [r.name for r in own.find_related(names).collect()]
    assert own.list_index().columns[:2] == ["id", "source"]


def test_bounds():
    assert len(PERMISSIONS) == 12 and check("x", 3, 1, 5) == 3 and check_date("d", None) is None
    for bad in (0, 6, True, "3"):
        with pytest.raises(ValueError):
            check("x", bad, 1, 5)
    with pytest.raises(ValueError):
        check_date("d", "2024-1-1")
    with pytest.raises(ValueError):
        Engine({}).list_index()


def two_tenants(spark):
    """The same url, name, note and text in two scopes, each with words of its own."""
    make, other = spark.createDataFrame, ("hosted", "t", "w")
    page = lambda word: "<html><title>T</title><body><article>" + f"<p>Redis is {word} by far the fastest store here.</p>" * 12 + "</article></body></html>"
    text = lambda word: f"Redis is {word} by far the fastest store here. " * 3
    return Engine({
        "docs": make([("d", "doc:d", "D", "c", text("alpha"), 1, 1, *HERE), ("e", "doc:e", "E", "c", text("beta"), 1, 2, *other)], f"id string, source string, title string, category string, content string, chunk_count int, ts long, {S}"),
        "chunks": make([("d:0", "d", 0, text("alpha"), 1, *HERE), ("e:0", "e", 0, text("beta"), 1, *other)], f"chunk_id string, doc_id string, chunk_index int, text string, ts long, {S}"),
        "vectors": make([("d:0", [0.0] * 64), ("e:0", [0.0] * 64)], "chunk_id string, embedding array<double>"),
        "entities": make([(*HERE, "1", "Redis", 1), (*HERE, "2", "Alpha", 1), (*other, "1", "Redis", 1), (*other, "3", "Beta", 1)], f"{S}, entity_id string, name string, mention_count long"),
        "links": make([(*HERE, "d", "1", 1), (*HERE, "d", "2", 1), (*other, "e", "1", 1), (*other, "e", "3", 1)], f"{S}, doc_id string, entity_id string, count int"),
        "notes": make([("n1", "redis alpha", "t", "s", 1, 1, *HERE), ("n2", "redis beta", "t", "s", 1, 1, *other)], f"id string, text string, topic string, session string, ts long, seq long, {S}"),
        "pages": make([(*HERE, "https://a.org/x", page("alpha"), "docs", 10), (*HERE, "https://a.org/x", page("old"), "docs", 5), (*other, "https://a.org/x", page("beta"), "docs", 99)], f"{S}, url string, content string, category string, ts long"),
        "results": make([(q, "duckduckgo", 0, p, u, u) for q in (1, 2) for p, u in ((1, "https://a.org/x"), (2, "https://none.org/"))], "query_id long, provider string, provider_ord int, pos int, url string, title string"),
        "search_cache": make([], f"{S}, entry_id string, query string, namespace string, ttl_ms long, ts long, embedding array<float>, results array<struct<title:string,url:string,snippet:string,source:string,published_at:string>>"),
    }), make([(1, "redis fastest store", None, *HERE), (2, "redis fastest store", None, *other)], f"query_id long, query string, domain string, {S}")


def test_no_operation_mixes_tenants(spark):
    engine, asked = two_tenants(spark)
    told = {r.query_id: r for r in engine.research(asked).collect()}
    assert "alpha" in told[1].answer and "beta" not in told[1].answer and "old" not in told[1].answer
    assert "beta" in told[2].answer and "alpha" not in told[2].answer
    assert [(s.origin, s.url, s.status) for s in told[1].sources] == [("web", "https://a.org/x", "indexed"), ("web", "https://none.org/", "fetch_failed"), ("local", "doc:d", "already_indexed")]
    assert [s.source for s in told[1].sources] == [1, None, 2]
    deep = {r.query_id: r for r in engine.deep_search(asked).collect()}
    assert deep[1].pages_fetched == 1 and "alpha" in deep[1].answer and "beta" not in deep[1].answer
    assert sorted((r.query_id, r.hit_id) for r in engine.search_index(asked).collect()) == [(1, "d:0"), (2, "e:0")]
    assert {r.hit_id for r in engine.search_index(asked, source="doc:e").collect()} == {"e:0"}
    names = spark.createDataFrame([(*HERE, "redis"), ("hosted", "t", "w", "redis")], f"{S}, asked string")
    assert {(r.tenant_id, r.name) for r in engine.find_related(names).collect()} == {("local", "Alpha"), ("t", "Beta")}
    assert {(r.tenant_id, r.doc_id) for r in engine.find_documents(names).collect()} == {("local", "d"), ("t", "e")}
    wanted = spark.createDataFrame([("r1", "redis", None, None, *HERE), ("r2", None, "t", "s", "hosted", "t", "w"), ("r3", "zzz", None, None, *HERE)], f"request_id string, query string, topic string, session string, {S}")
    assert {(r.request_id, r.id) for r in engine.recall_all(wanted).collect()} == {("r1", "n1"), ("r2", "n2")}
    urls = spark.createDataFrame([("hosted", "t", "w", "https://a.org/x")], f"{S}, url string")
    assert {r.tenant_id for r in engine.fetch_content(urls, F.lit(100)).collect()} == {"t"}
    gone = spark.createDataFrame([("n1", "hosted", "t", "w")], f"id string, {S}")
    assert engine.forget(gone).count() == 2
    status = engine.server_status(spark.createDataFrame([("p", 1, 1, True)], "provider string, ts long, event_id long, ok boolean"))
    assert {(r.store, r.tenant_id, r.n) for r in status["stores"].filter("store = 'notes'").collect()} == {("notes", "local", 1), ("notes", "t", 1)}
    new = engine.research_index(asked, F.lit(7).cast("long"))
    assert sorted((r.tenant_id, r.source) for r in new["docs"].filter("category = 'research'").collect()) == [("local", "https://a.org/x"), ("t", "https://a.org/x")]
    assert all(("alpha" in r.text) != ("beta" in r.text) for r in new["chunks"].collect())
    assert Engine(engine.tables | new).research(asked).first().sources[0].status == "already_indexed"


def test_search_options(spark):
    make = spark.createDataFrame
    rows = [(1, "p1", 0, 1, "https://a.org/1", "A", 0, "2024-05-01"), (1, "p1", 0, 2, "https://b.org/2", "B", 0, "2020-01-01"), (1, "p2", 1, 1, "https://c.org/3", "C", 0, None), (1, "p1", 0, 1, "https://d.org/4", "D", 1, None)]
    engine = Engine({"results": make(rows, "query_id long, provider string, provider_ord int, pos int, url string, title string, variant int, published_at string")}, ["p1", "p2"])
    asked = make([(1, "db backup", None, *HERE)], f"query_id long, query string, domain string, {S}")
    urls = lambda **o: [r.url for r in engine.web_search(asked, **o).orderBy("rank").collect()]
    assert urls() == ["https://a.org/1", "https://b.org/2"]
    assert set(urls(strategy="aggregate")) == {"https://a.org/1", "https://b.org/2", "https://c.org/3"}
    assert urls(from_date="2024-01-01") == ["https://a.org/1"] and urls(to_date="2023-12-31") == ["https://b.org/2"]
    assert set(urls(expand_query=True)) == {"https://a.org/1", "https://b.org/2", "https://d.org/4"}
    assert urls(max_results=1) == ["https://a.org/1"] and len(urls(strategy="auto")) >= 2
    for bad in ({"strategy": "x"}, {"max_results": 0}, {"from_date": "yesterday"}):
        with pytest.raises(ValueError):
            engine.web_search(asked, **bad)


def test_search_cache(spark):
    engine, asked = two_tenants(spark)
    first = engine.web_search(asked, now=F.lit(1000)).cache()
    assert {r["cache"] for r in first.collect()} == {"miss"} and first.count() == 4
    engine.tables["search_cache"] = engine.cache_results(asked.filter("query_id = 1"), first.filter("query_id = 1"), F.lit(1000))
    again = engine.web_search(asked, now=F.lit(2000)).collect()
    assert {(r.query_id, r["cache"]) for r in again} == {(1, "hit"), (2, "miss")}
    assert [r.url for r in sorted(again, key=lambda r: r.rank) if r.query_id == 1] == ["https://a.org/x", "https://none.org/"]
    assert {r["cache"] for r in engine.web_search(asked, now=F.lit(10_000_000)).collect()} == {"miss"}
    assert {r["cache"] for r in engine.web_search(asked, now=F.lit(2000), from_date="2024-01-01").collect()} == {"miss"}


def test_ingest_extends_the_stored_index_and_the_vectors(spark, engine, tmp_path):
    from larkspan.operators.inverted import build_index

    tables = engine.tables | {"vectors": spark.createDataFrame([], "chunk_id string, embedding array<double>")}
    stored = build_index(Engine.lexical_texts(tables["chunks"], tables["docs"]), f"file://{tmp_path}/i", ("source",))
    own = Engine(tables, lexical=stored)
    pages = spark.createDataFrame([("n", "web:n", "T", "c", "pooling with redis " * 30, 9, *HERE)], f"id string, source string, title string, category string, content string, ts long, {S}")
    after = own.ingest_document(pages)
    asked = spark.createDataFrame([(1, "redis pooling", *HERE)], f"query_id long, query string, {S}")
    now, plain = Engine(tables | after, lexical=stored), Engine({k: v for k, v in (tables | after).items()})
    rows = lambda e, **more: [(r.hit_id, r.score, r.matched_by) for r in e.search_index(asked, **more).orderBy("rank").collect()]
    assert rows(now) == rows(plain) and rows(now)[0][0].startswith("n:") and rows(now)[0][2] == "hybrid"
    assert [h for h, *_ in rows(now, source="web:n")] == [h for h, *_ in rows(plain, source="web:n")]
    assert {r.chunk_id for r in after["vectors"].collect()} == {r.chunk_id for r in after["chunks"].collect() if r.doc_id == "n"}
