"""The entity graph and session notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.catalog import query
from larkspan.operators import graph, notes
from larkspan.operators.ranking import top_k_per
from larkspan.plans.bases import base, sub
from larkspan.sources.stores import ScopedStores

_S = "execution_mode, tenant_id, workspace_id"
_KEYS = ["execution_mode", "tenant_id", "workspace_id"]

#: A definition of entities that SQL shares: capitalised words of four to seven ASCII letters.
_MENTIONS = f"(SELECT {_S}, doc_id, name, count(*) AS n FROM (SELECT {_S}, doc_id, unnest(regexp_extract_all(content, '[A-Z][a-z]{{3,6}}')) AS name FROM {sub('docs')}) GROUP BY ALL)"
_ENTITIES = f"(SELECT {_S}, sha1(lower(name)) AS entity_id, arg_min(name, doc_id * 1000000 - n * 100 + ord(name[1])) AS name, sum(n) AS mention_count FROM {_MENTIONS} GROUP BY {_S}, sha1(lower(name)))"
_LINKS = f"(SELECT {_S}, doc_id, sha1(lower(name)) AS entity_id, min(n) AS count FROM {_MENTIONS} GROUP BY {_S}, doc_id, sha1(lower(name)))"


def _mentions(spark, d):
    words = base(spark, d, "docs").select(*_KEYS, "doc_id", F.explode(F.regexp_extract_all("content", F.lit("[A-Z][a-z]{3,6}"), F.lit(0))).alias("name"))
    return words.groupBy(*_KEYS, "doc_id", "name").agg(F.count("*").alias("n"))


def _graph(spark, d):
    return graph.mentions_to_graph(_mentions(spark, d))


@query("agg4_mentions", f"SELECT * FROM {_MENTIONS}")
def agg4_mentions(spark, d):
    return _mentions(spark, d)


@query("fns27_entity_ids", f"SELECT {_S}, entity_id, mention_count FROM {_ENTITIES}")
def fns27_entity_ids(spark, d):
    return _graph(spark, d)[0].select(*_KEYS, "entity_id", "mention_count")


@query("agg5_additive_mentions", f"SELECT {_S}, entity_id, 2 * mention_count AS mention_count FROM {_ENTITIES}")
def agg5_additive_mentions(spark, d):
    """Indexing every document again replaces its links and adds its mentions."""
    entities, links = _graph(spark, d)
    return graph.index_documents(entities, links, _mentions(spark, d))[0].select(*_KEYS, "entity_id", "mention_count")


@query("dml5_reindexed_links", f"SELECT {_S}, doc_id, entity_id, count FROM {_LINKS}")
def dml5_reindexed_links(spark, d):
    entities, links = _graph(spark, d)
    return graph.index_documents(entities, links, _mentions(spark, d))[1].select(*_KEYS, "doc_id", "entity_id", "count")


def _names(spark, d):
    return base(spark, d, "docs").select(*_KEYS).distinct().select(*_KEYS, F.explode(F.array(F.lit("and"), F.lit("THAT"), F.lit("eine"))).alias("asked"))


_ASKED = f"(SELECT {_S}, unnest(['and', 'THAT', 'eine']) AS asked FROM (SELECT DISTINCT {_S} FROM {sub('docs')}))"


@query("join4_documents_of_entity", f"""
SELECT a.*, l.doc_id, l.count FROM {_ASKED} a JOIN {_LINKS} l ON l.entity_id = sha1(lower(a.asked)) AND l.tenant_id = a.tenant_id AND l.workspace_id = a.workspace_id AND l.execution_mode = a.execution_mode""")
def join4_documents_of_entity(spark, d):
    entities, links = _graph(spark, d)
    docs = base(spark, d, "docs").select(*_KEYS, "doc_id", "source", F.lit("").alias("title"), "ts")
    return graph.documents_of(entities, links, docs, _names(spark, d)).select(*_KEYS, "asked", "doc_id", "count")


_OWN_SCOPE = "{0}.execution_mode = 'hosted' AND {0}.tenant_id = 't1' AND {0}.workspace_id = 'w1'"


@query("flt1_stored_scope", f"SELECT doc_id, source FROM {sub('docs')} d WHERE {_OWN_SCOPE.format('d')}")
def flt1_stored_scope(spark, d):
    """From a store that is partitioned by scope: the scan reads one scope's files."""
    stores = ScopedStores(spark).save("docs", base(spark, d, "docs"))
    return stores.of("hosted", "t1", "w1").table("docs").select("doc_id", "source")


@query("join4_stored_scope", f"""
SELECT n.asked, l.doc_id, l.count FROM (SELECT DISTINCT asked FROM {_ASKED}) n JOIN {_LINKS} l ON l.entity_id = sha1(lower(n.asked)) WHERE {_OWN_SCOPE.format('l')}""")
def join4_stored_scope(spark, d):
    """Documents and links of one scope, which meet bucket by bucket."""
    stores = ScopedStores(spark).save("docs", base(spark, d, "docs").drop("content")).save("links", _graph(spark, d)[1])
    return stores.of("hosted", "t1", "w1").documents_of(_names(spark, d).select("asked").distinct()).select("asked", "doc_id", "count")


@query("join6_related_entities", f"""
SELECT a.execution_mode, a.tenant_id, a.workspace_id, a.asked, m.entity_id, count(*) AS cooccurrence FROM {_ASKED} a
JOIN {_LINKS} l ON l.entity_id = sha1(lower(a.asked)) AND l.tenant_id = a.tenant_id AND l.workspace_id = a.workspace_id AND l.execution_mode = a.execution_mode
JOIN {_LINKS} m ON m.doc_id = l.doc_id AND m.entity_id <> l.entity_id AND m.tenant_id = l.tenant_id AND m.workspace_id = l.workspace_id AND m.execution_mode = l.execution_mode GROUP BY ALL""")
def join6_related_entities(spark, d):
    entities, links = _graph(spark, d)
    from larkspan.functions.text import entity_id

    return graph.related(entities, links, _names(spark, d)).select(*_KEYS, "asked", entity_id(F.col("name")).alias("entity_id"), "cooccurrence")


@query("srt4_top_related", f"""
WITH c AS (SELECT a.execution_mode, a.tenant_id, a.workspace_id, a.asked, m.entity_id, count(*) AS cooccurrence FROM {_ASKED} a
JOIN {_LINKS} l ON l.entity_id = sha1(lower(a.asked)) AND l.tenant_id = a.tenant_id AND l.workspace_id = a.workspace_id AND l.execution_mode = a.execution_mode
JOIN {_LINKS} m ON m.doc_id = l.doc_id AND m.entity_id <> l.entity_id AND m.tenant_id = l.tenant_id AND m.workspace_id = l.workspace_id AND m.execution_mode = l.execution_mode GROUP BY ALL)
SELECT * EXCLUDE (rank) FROM (SELECT *, row_number() OVER (PARTITION BY execution_mode, tenant_id, workspace_id, asked ORDER BY cooccurrence DESC, entity_id) AS rank FROM c) WHERE rank <= 10""")
def srt4_top_related(spark, d):
    return top_k_per(join6_related_entities(spark, d), [*_KEYS, "asked"], [F.col("cooccurrence").desc(), "entity_id"], 10).drop("rank")


@query("join7_entities_of_document", f"SELECT doc_id, count(*) AS entities, sum(count) AS mentions FROM {_LINKS} GROUP BY 1")
def join7_entities_of_document(spark, d):
    entities, links = _graph(spark, d)
    own = links.join(entities.select(*_KEYS, "entity_id"), [*_KEYS, "entity_id"])
    return own.groupBy("doc_id").agg(F.count("*").alias("entities"), F.sum("count").alias("mentions"))


@query("agg12_extraction_scores", f"""
WITH e AS (SELECT doc_id, name, n FROM {_MENTIONS} WHERE length(name) < 7), a AS (SELECT doc_id, name, n FROM {_MENTIONS} WHERE length(name) > 4),
j AS (SELECT e.n AS want, a.n AS got FROM e FULL JOIN a USING (doc_id, name)),
s AS (SELECT count(*) FILTER (WHERE want IS NOT NULL AND got IS NOT NULL) AS tp, count(*) FILTER (WHERE want IS NULL) AS fp, count(*) FILTER (WHERE got IS NULL) AS fn, count(*) FILTER (WHERE want <> got) AS mismatches FROM j)
SELECT tp, fp, fn, mismatches, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall FROM s""")
def agg12_extraction_scores(spark, d):
    from larkspan.operators.evaluation import extraction_scores

    rows = _mentions(spark, d).select(F.col("doc_id").alias("case_id"), "name", "n")
    out = extraction_scores(rows.filter(F.length("name") < 7), rows.filter(F.length("name") > 4))
    return out.select("tp", "fp", "fn", "mismatches", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("srt3_notes_by_recency", f"SELECT id, rank FROM (SELECT *, row_number() OVER (PARTITION BY {_S} ORDER BY ts DESC, seq DESC) AS rank FROM {sub('notes')}) WHERE rank <= 50")
def srt3_notes_by_recency(spark, d):
    return notes.listed(base(spark, d, "notes")).select("id", "rank")


@query("flt11_notes_filter", f"SELECT id, rank FROM (SELECT *, row_number() OVER (PARTITION BY {_S} ORDER BY ts DESC, seq DESC) AS rank FROM {sub('notes')} WHERE topic = 'user') WHERE rank <= 10")
def flt11_notes_filter(spark, d):
    return notes.listed(base(spark, d, "notes"), 10, F.col("topic") == "user").select("id", "rank")


_OVERLAP = "(contains(h, 'the')::INT + contains(h, 'les')::INT + contains(h, 'der')::INT + contains(h, 'the')::INT)"


@query("ret16_notes_recall", f"""
WITH r AS (SELECT *, lower(text || ' ' || topic || ' ') AS h, row_number() OVER (PARTITION BY {_S} ORDER BY ts DESC, seq DESC) AS n FROM {sub('notes')}),
s AS (SELECT *, {_OVERLAP} AS score FROM r WHERE n <= 500)
SELECT id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY {_S} ORDER BY score DESC, n) AS rank FROM s WHERE score > 0) WHERE rank <= 10""")
def ret16_notes_recall(spark, d):
    return notes.search(base(spark, d, "notes"), "the les, der THE", 10).select("id", "score", "rank")


@query("fnm7_token_overlap", f"SELECT id, {_OVERLAP} AS score FROM (SELECT *, lower(text) AS h FROM {sub('notes')})")
def fnm7_token_overlap(spark, d):
    from larkspan.functions.text import note_tokens, overlap

    return base(spark, d, "notes").select("id", overlap(note_tokens(F.lit("the les, der THE")), F.lower("text")).alias("score"))
