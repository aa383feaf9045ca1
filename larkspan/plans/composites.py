"""Connectors, page chains and joins of what the other plans make, over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.catalog import ORACLE_SQL, query, table
from larkspan.functions import routing, text
from larkspan.operators import evaluation, fetching, graph, index, ranking
from larkspan.operators.nearest import nearest
from larkspan.plans.bases import base, sub
from larkspan.plans.graph_memory import _KEYS, _S, _graph, _names, join4_documents_of_entity, join6_related_entities
from larkspan.plans.ranking import _METRICS, _relevant, _retrieved
from larkspan.plans.relational import _SQL_GRANTED, join5_active_memberships
from larkspan.plans.retrieval import BM25_SQL, _queries, _texts
from larkspan.sources import documents, providers

_COSINE = "round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6)"


@query("src2_scanned_files")
def src2_scanned_files(spark, d):
    """The files of the tables' folder; contents aren't read."""
    found = documents.scan(spark, [d], 1 << 40)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")



def _archives(spark, d, kind):
    """A document file of each benchmark item, made here so that there is something to read."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    def made(title: str, body: str) -> bytes:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as file:
            if kind == "docx":
                w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
                file.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>{escape(title)}</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>{escape(body)}</w:t></w:r></w:p></w:body></w:document>")
            else:
                file.writestr("mimetype", "application/epub+zip")
                file.writestr("META-INF/container.xml", '<container><rootfile full-path="o/p.opf"/></container>')
                file.writestr("o/p.opf", f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>{escape(title)}</dc:title></metadata><manifest><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="a"/></spine></package>')
                file.writestr("o/a.xhtml", f"<body><p>{escape(body)}</p></body>")
        return buffer.getvalue()

    title = F.concat(F.lit("Item "), F.col("item_id").cast("string"))
    files = table(spark, d, "benchmark").select(F.concat("item_id", F.lit(f".{kind}")).alias("path"), F.udf(made, "binary", useArrow=True)(title, F.col("text")).alias("content"))
    return documents.extracted(files)


@query("src7_docx_documents", "SELECT item_id || '.docx' AS path, 'docx' AS format, 'Item ' || item_id || chr(10) || chr(10) || trim(text) AS text, CAST(NULL AS VARCHAR) AS error FROM benchmark")
def src7_docx_documents(spark, d):
    return _archives(spark, d, "docx").select("path", "format", "text", "error")


@query("src8_epub_documents", "SELECT item_id || '.epub' AS path, 'epub' AS format, 'Item ' || item_id AS title, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM benchmark")
def src8_epub_documents(spark, d):
    return _archives(spark, d, "epub").select("path", "format", "title", "text")


@query("src6_archives_within_bounds", "SELECT 2 * count(*) AS files, 0 AS refused FROM benchmark")
def src6_archives_within_bounds(spark, d):
    both = _archives(spark, d, "docx").unionByName(_archives(spark, d, "epub"))
    return both.agg(F.count("*").alias("files"), F.count_if(F.col("error").isNotNull()).cast("int").alias("refused"))


_ANSWERED = (("brave", "brave"), ("searxng", "google"), ("tavily", "bing"), ("exa", "brave"))


@query("src19b_api_connectors", " UNION ALL ".join(f"SELECT query_id, '{api}' AS provider, pos, title, url, 'About ' || page_id AS snippet, {date} AS published_at FROM {sub('results')} WHERE provider = '{own}'" for (api, own), date in zip(_ANSWERED, ("CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)", "'2024-05-01'", "'2024-05-01'"), strict=True)))
def src19b_api_connectors(spark, d):
    """Each list of results as an answer of an API in JSON, read back."""
    about = F.concat(F.lit("<b>About</b>  "), F.col("page_id").cast("string"))
    item = F.struct("pos", F.struct("title", "url", about.alias("description"), about.alias("content"), about.alias("text"), F.lit("2024-05-01T10:00:00Z").alias("published_date"), F.lit("2024-05-01T10:00:00Z").alias("publishedDate")).alias("r"))
    lists = base(spark, d, "results").groupBy("query_id", "provider").agg(F.array_sort(F.collect_list(item), lambda a, b: a["pos"] - b["pos"]).alias("l"))
    lists = lists.select("query_id", "provider", F.transform("l", lambda x: x["r"]).alias("results"))
    out = None
    for api, own in _ANSWERED:
        body = F.to_json(F.struct(F.struct("results").alias("web")) if api == "brave" else F.struct("results"))
        rows = providers.from_api(api, lists.filter(F.col("provider") == own).select("query_id", body.alias("body")))
        out = rows if out is None else out.unionByName(rows)
    return out


def _candidates(spark, d):
    """What each source of the chain recorded for a page: the cache has every third, raw text every second, the page all."""
    pages = base(spark, d, "cache").select("url", "page_id", "content")
    i = F.col("page_id")
    sources = [(0, "cache", F.when(i % 3 == 0, F.concat(F.lit("cached "), i.cast("string")))), (1, "raw", F.when(i % 2 == 0, F.concat(F.lit("raw "), i.cast("string"))).otherwise(" ")), (2, "html", F.col("content"))]
    out = None
    for ordinal, origin, content in sources:
        rows = pages.select("url", F.lit(ordinal).alias("ordinal"), F.lit(origin).alias("origin"), F.concat(F.lit("Page "), i.cast("string")).alias("title"), content.alias("content"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("src11_page_chain", """
SELECT url, CASE WHEN NOT regexp_matches(url, '^https?://') THEN NULL WHEN bool_or(page_id % 3 = 0) THEN 'cache' WHEN bool_or(page_id % 2 = 0) THEN 'raw' ELSE 'html' END AS origin,
  CASE WHEN NOT regexp_matches(url, '^https?://') THEN 'unsupported_protocol' END AS error FROM pages GROUP BY url""")
def src11_page_chain(spark, d):
    return fetching.page_chain(table(spark, d, "pages"), _candidates(spark, d)).select("url", "origin", "error")


@query("src25_raw_articles", "SELECT 'https://raw.test/' || item_id AS url, CASE WHEN item_id % 3 = 0 THEN 0 ELSE 1 END AS ordinal, CASE WHEN item_id % 3 = 0 THEN 'Head ' || item_id ELSE CAST(item_id AS VARCHAR) END AS title FROM benchmark")
def src25_raw_articles(spark, d):
    """Every third has a first candidate that is long enough; the others' is too short, and the second has no heading."""
    items, i = table(spark, d, "benchmark"), F.col("item_id").cast("string")
    url = F.concat(F.lit("https://raw.test/"), i).alias("url")
    first = items.select(url, F.lit(0).alias("ordinal"), F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("# Head "), i, F.lit("\n\nlong enough to be an article"))).otherwise("# too short").alias("raw"))
    second = items.select(url, F.lit(1).alias("ordinal"), F.lit("a second candidate without any heading").alias("raw"))
    return fetching.raw_articles(first.unionByName(second)).select("url", "ordinal", "title")


@query("snk3_kept_articles", f"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY {_S}, url ORDER BY ts DESC) AS nth FROM {sub('cache')})
SELECT execution_mode, url, CASE WHEN page_id % 2 = 0 THEN 9000000000000 ELSE ts END AS ts, page_id % 2 = 0 AS kept FROM n WHERE nth = 1""")
def snk3_kept_articles(spark, d):
    old = base(spark, d, "cache").withColumn("published_at", F.lit(None).cast("string"))
    read = old.filter("page_id % 2 = 0").select(*_KEYS, "url", F.lit("a title").alias("title"), F.lit("kept​ text").alias("content"))
    out = fetching.keep_articles(old.drop("page_id"), read, F.lit(9_000_000_000_000))
    return out.select("execution_mode", "url", "ts", (F.col("content") == "kept text").alias("kept"))


@query("src23_membership_source", f"SELECT principal_id, workspace_id, revoked_at IS NULL AS active FROM {sub('memberships')}")
def src23_membership_source(spark, d):
    return base(spark, d, "memberships").select("principal_id", "workspace_id", F.col("revoked_at").isNull().alias("active"))


@query("join2_vectors_with_documents", f"""
WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS hit_id, {_COSINE} AS sim FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, hit_id) AS rank FROM s)
SELECT query_id, hit_id, sim, source, lang FROM r JOIN documents d ON d.doc_id = hit_id WHERE rank <= 5""")
def join2_vectors_with_documents(spark, d):
    v = table(spark, d, "embeddings")
    found = nearest(v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v.select(F.col("vec_id").alias("hit_id"), "embedding"), 5)
    return found.join(table(spark, d, "documents").select(F.col("doc_id").alias("hit_id"), "source", "lang"), "hit_id").select("query_id", "hit_id", "sim", "source", "lang")


@query("srt2_distance_order", f"""
WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS hit_id, {_COSINE} AS sim FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0)
SELECT query_id, hit_id, round(1 - sim, 6) AS distance, nth FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, hit_id) AS nth FROM s) WHERE nth <= 20""")
def srt2_distance_order(spark, d):
    v = table(spark, d, "embeddings")
    found = nearest(v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v.select(F.col("vec_id").alias("hit_id"), "embedding"), 20)
    return found.select("query_id", "hit_id", F.round(1 - F.col("sim"), 6).alias("distance"), F.col("rank").alias("nth"))


@query("join3_cache_metadata", f"""
WITH v AS {sub('vectors')}, s AS (SELECT q.vec_id AS query_id, v.vec_id AS hit_id, v.ts, {_COSINE} AS sim FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.namespace = v.namespace),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, hit_id) AS rank FROM s)
SELECT query_id, hit_id, sim, ts FROM r WHERE rank <= 5""")
def join3_cache_metadata(spark, d):
    v = base(spark, d, "vectors").withColumnRenamed("namespace", "grp")
    found = nearest(v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "grp"), v.select(F.col("vec_id").alias("hit_id"), "embedding", "grp"), 5, same_group=True)
    return found.join(v.select(F.col("vec_id").alias("hit_id"), "ts"), "hit_id").select("query_id", "hit_id", "sim", "ts")


_CONFIGURED = "(SELECT l_orderkey AS request, list(DISTINCT name) AS names FROM (SELECT l_orderkey, ['google','bing','brave','duckduckgo','exa'][1 + l_linenumber % 5] AS name FROM lineitem) GROUP BY 1)"


def _planned(spark, d):
    name = F.element_at(F.array(*map(F.lit, ("google", "bing", "brave", "duckduckgo", "exa"))), (F.col("l_linenumber") % 5 + 1).cast("int"))
    own = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("request")).agg(F.array_sort(F.collect_set(name)).alias("names"))
    return own.select("request", "names", routing.plan(F.lit("technical"), F.col("names")).alias("p"))


_PREFERRED = "list_concat(list_filter(['searxng','brave','duckduckgo','bing','google'], lambda x: list_contains(names, x)), list_sort(list_filter(names, lambda x: NOT list_contains(['searxng','brave','duckduckgo','bing','google'], x))))"


@query("join11_preferred_providers", f"SELECT request, list_slice({_PREFERRED}, 1, 2) AS first_names FROM {_CONFIGURED}")
def join11_preferred_providers(spark, d):
    return _planned(spark, d).select("request", F.col("p.primary").alias("first_names"))


@query("set4_remaining_providers", f"SELECT request, list_sort(list_filter(names, lambda x: NOT list_contains(list_slice({_PREFERRED}, 1, 2), x))) AS left_names FROM {_CONFIGURED}")
def set4_remaining_providers(spark, d):
    return _planned(spark, d).select("request", F.array_sort("p.fallback").alias("left_names"))


@query("join12_plan_order", f"SELECT request, unnest(range(0, len(p))) AS place, unnest(p) AS provider FROM (SELECT request, list_slice({_PREFERRED}, 1, 2) AS p FROM {_CONFIGURED})")
def join12_plan_order(spark, d):
    return _planned(spark, d).select("request", F.posexplode("p.primary").alias("place", "provider")).withColumn("place", F.col("place").cast("long"))


@query("set2_united_providers", f"SELECT query_id, list_sort(list(DISTINCT provider)) AS providers FROM {sub('results')} GROUP BY 1")
def set2_united_providers(spark, d):
    """Two relations of providers, as of two variants of a query, united."""
    rows = base(spark, d, "results").select("query_id", "provider")
    both = rows.filter("provider <> 'bing'").union(rows.filter("provider <> 'brave'")).distinct()
    return both.groupBy("query_id").agg(F.array_sort(F.collect_set("provider")).alias("providers"))


@query("set5_distinct_sources", "SELECT DISTINCT lang, source FROM documents")
def set5_distinct_sources(spark, d):
    return table(spark, d, "documents").select("lang", "source").distinct()


@query("set4_customers_without_orders", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set4_customers_without_orders(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").filter("o_orderstatus = 'P'").select("o_custkey"))


@query("agg3_cooccurrence", f"""
WITH c AS (SELECT a.execution_mode, a.tenant_id, a.workspace_id, a.asked, m.entity_id, count(DISTINCT m.doc_id) AS n FROM
 (SELECT {_S}, unnest(['and', 'THAT', 'eine']) AS asked FROM (SELECT DISTINCT {_S} FROM {sub('docs')})) a
 JOIN (SELECT DISTINCT {_S}, doc_id, sha1(lower(unnest(regexp_extract_all(content, '[A-Z][a-z]{{3,6}}')))) AS entity_id FROM {sub('docs')}) l ON l.entity_id = sha1(lower(a.asked)) AND l.tenant_id = a.tenant_id AND l.workspace_id = a.workspace_id AND l.execution_mode = a.execution_mode
 JOIN (SELECT DISTINCT {_S}, doc_id, sha1(lower(unnest(regexp_extract_all(content, '[A-Z][a-z]{{3,6}}')))) AS entity_id FROM {sub('docs')}) m ON m.doc_id = l.doc_id AND m.entity_id <> l.entity_id GROUP BY ALL)
SELECT execution_mode, tenant_id, workspace_id, asked, count(*) AS entities, CAST(sum(n) AS BIGINT) AS total, max(n) AS most FROM c GROUP BY ALL""")
def agg3_cooccurrence(spark, d):
    entities, links = _graph(spark, d)
    found = graph.related(entities, links, _names(spark, d))
    return found.groupBy(*_KEYS, "asked").agg(F.count("*").alias("entities"), F.sum("cooccurrence").alias("total"), F.max("cooccurrence").alias("most"))


@query("agg13_grouped_metrics", _METRICS + "SELECT query_id % 3 AS grp, query_id % 2 AS part, count(*) AS queries, round(avg(mrr), 9) AS mrr, round(avg(recall_3), 9) AS recall_3 FROM m GROUP BY GROUPING SETS ((query_id % 3, query_id % 2), ())")
def agg13_grouped_metrics(spark, d):
    found = evaluation.query_metrics(_retrieved(spark, d), _relevant(spark, d), [3]).withColumn("grp", F.col("query_id") % 3).withColumn("part", F.col("query_id") % 2)
    return evaluation.report(found, ["grp", "part"]).select("grp", "part", "queries", F.round("mrr", 9).alias("mrr"), F.round("recall_3", 9).alias("recall_3"))


@query("ret15_find_related", f"""
WITH docs_ AS ({ORACLE_SQL['join4_documents_of_entity']}), rel AS ({ORACLE_SQL['join6_related_entities']})
SELECT execution_mode, tenant_id, workspace_id, asked, 'document' AS kind, CAST(doc_id AS VARCHAR) AS found, n FROM (SELECT *, count AS n, row_number() OVER (PARTITION BY {_S}, asked ORDER BY count DESC, doc_id DESC) AS r FROM docs_) WHERE r <= 5
UNION ALL SELECT execution_mode, tenant_id, workspace_id, asked, 'entity', entity_id, cooccurrence FROM (SELECT *, row_number() OVER (PARTITION BY {_S}, asked ORDER BY cooccurrence DESC, entity_id) AS r FROM rel) WHERE r <= 10""")
def ret15_find_related(spark, d):
    """Of each name asked for the documents that mention it most and the entities that occur with it most."""
    docs = ranking.top_k_per(join4_documents_of_entity(spark, d), [*_KEYS, "asked"], [F.col("count").desc(), F.col("doc_id").desc()], 5)
    docs = docs.select(*_KEYS, "asked", F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("found"), F.col("count").alias("n"))
    near = ranking.top_k_per(join6_related_entities(spark, d), [*_KEYS, "asked"], [F.col("cooccurrence").desc(), "entity_id"], 10)
    return docs.unionByName(near.select(*_KEYS, "asked", F.lit("entity").alias("kind"), F.col("entity_id").alias("found"), F.col("cooccurrence").alias("n")))


@query("ret18_provider_benchmark", f"""
SELECT provider, '| ' || provider || ' | ' || count(*) FILTER (WHERE status = 'ok') || '/' || count(*) || ' | ' || CAST(round(quantile_disc(duration_ms, 0.5)) AS BIGINT) || ' | ' || CAST(round(quantile_disc(duration_ms, 0.95)) AS BIGINT) || ' |' AS line FROM {sub('attempts')} GROUP BY 1""")
def ret18_provider_benchmark(spark, d):
    return evaluation.benchmark_lines(base(spark, d, "attempts"))


@query("srt6_result_budget", "SELECT item_id, least(10, 1 + item_id % 5 + 2) AS asked, least(1 + item_id % 5, 3) AS local_hits FROM benchmark")
def srt6_result_budget(spark, d):
    """A request for one to five sources looks at two more results, ten at most, and at three local hits."""
    sources = F.col("item_id") % 5 + 1
    return table(spark, d, "benchmark").select("item_id", F.least(F.lit(10), sources + 2).alias("asked"), F.least(sources, F.lit(3)).alias("local_hits"))


@query("flt12_good_passages", "SELECT doc_id, len(list_filter(list_transform(string_split_regex(text, '\\n{2,}|\\n---\\n'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: len(x) >= 40)) AS passages FROM documents WHERE text IS NOT NULL")
def flt12_good_passages(spark, d):
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.size(text.paragraphs(F.col("text"))).cast("long").alias("passages"))


@query("fnm3_positive_scores", BM25_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hit_id) AS rank FROM scored) SELECT query_id, min(score) > 0 AS positive, count(*) AS n FROM r WHERE rank <= 10 GROUP BY 1")
def fnm3_positive_scores(spark, d):
    return index.keyword_hits(_queries(spark, d), _texts(spark, d), 10).groupBy("query_id").agg((F.min("score") > 0).alias("positive"), F.count("*").alias("n"))


@query("gov2_effective_permissions", f"""
SELECT m.principal_id, w.workspace_id, list_filter({_SQL_GRANTED}, lambda x: x IN ('content:read', 'memory:read', 'knowledge:write')) AS effective FROM {sub('memberships')} m
JOIN {sub('workspaces')} w USING (workspace_id) WHERE m.revoked_at IS NULL AND w.disabled_at IS NULL""")
def gov2_effective_permissions(spark, d):
    token = F.array(*map(F.lit, ("content:read", "memory:read", "knowledge:write")))
    return join5_active_memberships(spark, d).select("principal_id", "workspace_id", F.array_intersect("permissions", token).alias("effective"))
