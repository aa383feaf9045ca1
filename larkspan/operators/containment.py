"""Which texts hold which passages, by the rarest word of a passage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.functions.text import index_tokens
from larkspan.operators.inverted import InvertedIndex
from larkspan.tables import materialize


def _anchors(passages: DataFrame, index: InvertedIndex) -> DataFrame:
    """(query_id, term): a text that holds the passage has one of its terms."""
    lexicon = index.table("lexicon").groupBy("term").agg(F.sum("n_docs").alias("n_docs"))
    tokens = passages.select("query_id", index_tokens(F.col("passage")).alias("tokens")).withColumn("n", F.size("tokens"))
    # All tokens but the first and the last are whole words of such a text.
    inner = tokens.filter("n > 2").select("query_id", F.explode(F.expr("array_distinct(slice(tokens, 2, n - 2))")).alias("term"))
    rarest = inner.join(lexicon, "term", "left").groupBy("query_id").agg(F.min_by("term", F.struct(F.coalesce("n_docs", F.lit(0)), "term")).alias("term"))
    # Of a shorter passage the longer token is at least a part of a word.
    part = F.expr("IF(n = 1 OR length(tokens[0]) >= length(tokens[1]), tokens[0], tokens[1])")
    short = tokens.filter("n BETWEEN 1 AND 2").select("query_id", part.alias("part"))
    lengths = sorted(r[0] for r in short.select(F.length("part")).distinct().collect())
    if not lengths:
        return rarest
    each = ", ".join(f"transform(IF(length(term) >= {n}, sequence(1, length(term) - {n - 1}), array()), i -> substring(term, i, {n}))" for n in lengths)
    pieces = F.explode(F.expr(f"array_distinct(flatten(array({each})))"))
    return rarest.unionByName(lexicon.select("term", pieces.alias("part")).join(short, "part").select("query_id", "term"))


def containing(passages: DataFrame, texts: DataFrame, index: InvertedIndex) -> DataFrame:
    """(query_id, hit_id) of passages (query_id, passage) and texts (hit_id, text) that hold them as they are.

    A passage's rarest inner word says where it can be; only there it is looked for. The index is that of the texts.
    Letters whose lower case depends on their place in a word (the final sigma) count as at their place in the passage; only at
    the edge of a passage of one or two words can that differ from the text. Defined results: a passage without a letter or digit, or a null one, is in no text; equal pairs come once.
    """
    anchors = materialize(_anchors(passages, index), "anchors")
    places = index.postings(anchors).join(anchors, "term").select("query_id", "hit_id").distinct()
    met = places.join(texts.select("hit_id", "text"), "hit_id").join(passages.select("query_id", "passage"), "query_id")
    return met.filter(F.contains("text", "passage")).select("query_id", "hit_id").distinct()
