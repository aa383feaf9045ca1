"""The entity graph: entities of documents, documents of an entity, entities that occur together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.functions.text import entity_id
from larkspan.operators.changes import replace_by, upsert_add
from larkspan.operators.ranking import first_per
from larkspan.schemas import SCOPE

_SCOPE = list(SCOPE)


def mentions_to_graph(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, links) of mentions (scope, doc_id, name, n).

    Names that differ in case alone are one entity; it keeps the spelling seen first (in order of document, then of
    number and name), a link keeps the smallest of such numbers, and the entity's total adds all up.
    """
    named = mentions.withColumn("entity_id", entity_id(F.col("name")))
    entities = named.groupBy(*_SCOPE, "entity_id").agg(F.min_by("name", F.struct("doc_id", -F.col("n"), "name")).alias("name"), F.sum("n").alias("mention_count"))
    links = first_per(named, [*_SCOPE, "doc_id", "entity_id"], ["n", F.col("name").desc()]).select(*_SCOPE, "doc_id", "entity_id", F.col("n").alias("count"))
    return entities, links


def index_documents(entities: DataFrame, links: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph after documents are indexed (again): their links are replaced, totals only ever grow."""
    more, fresh = mentions_to_graph(mentions)
    columns = [*_SCOPE, "entity_id", "name", "mention_count"]
    return upsert_add(entities.select(*columns), more.select(*columns), [*_SCOPE, "entity_id"], "mention_count", "name"), replace_by(links, fresh, [*_SCOPE, "doc_id"])


def documents_of(entities: DataFrame, links: DataFrame, docs: DataFrame, names: DataFrame) -> DataFrame:
    """(scope, asked, doc_id, source, title, count, ts) for each name asked for in its scope."""
    wanted = entities.join(names.withColumn("low", F.lower("asked")), [*_SCOPE]).filter(F.lower("name") == F.col("low"))
    return wanted.select(*_SCOPE, "asked", "entity_id").join(links, [*_SCOPE, "entity_id"]).join(docs, [*_SCOPE, "doc_id"]).select(*_SCOPE, "asked", "doc_id", "source", "title", "count", "ts")


def related(entities: DataFrame, links: DataFrame, names: DataFrame) -> DataFrame:
    """(scope, asked, name, cooccurrence): entities in documents of each name asked for, and in how many.

    Starts from the links of what is asked for, so only their documents' other links are joined: no pairs of all entities.
    """
    low = names.withColumn("low", F.lower("asked"))
    own = entities.withColumn("low", F.lower("name")).join(low, [*_SCOPE, "low"]).select(*_SCOPE, "asked", F.col("entity_id").alias("own_id"))
    first = links.withColumnRenamed("entity_id", "own_id").join(own, [*_SCOPE, "own_id"]).select(*_SCOPE, "asked", "own_id", "doc_id")
    others = first.join(links.select(*_SCOPE, "doc_id", "entity_id"), [*_SCOPE, "doc_id"]).filter("entity_id <> own_id")
    counted = others.groupBy(*_SCOPE, "asked", "entity_id").agg(F.count("*").alias("cooccurrence"))
    return counted.join(entities.select(*_SCOPE, "entity_id", "name"), [*_SCOPE, "entity_id"]).select(*_SCOPE, "asked", "name", "cooccurrence")
