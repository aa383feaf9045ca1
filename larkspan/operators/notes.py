"""Session notes: kept newest first, found by the words they contain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions.text import note_tokens, overlap
from larkspan.operators.ranking import top_k_per
from larkspan.schemas import SCOPE

MOST = 500


def clamp(limit: int | None, default: int, most: int) -> int:
    return min(max(limit if limit is not None else default, 1), most)


def evict(notes: DataFrame, most: int = MOST) -> DataFrame:
    """The newest notes of each scope."""
    return top_k_per(notes, list(SCOPE), [F.col("ts").desc(), F.col("seq").desc()], most, "_n").drop("_n")


def listed(notes: DataFrame, limit: int | None = None, where: Column | None = None) -> DataFrame:
    """Notes of each scope, newest first."""
    return top_k_per(notes, list(SCOPE), [F.col("ts").desc(), F.col("seq").desc()], clamp(limit, 50, 500), "rank", where)


def search(notes: DataFrame, query: str, limit: int | None = None, where: Column | None = None) -> DataFrame:
    """Among the newest notes of each scope those that contain most of the query's tokens, each time a token is given."""
    recent = top_k_per(notes, list(SCOPE), [F.col("ts").desc(), F.col("seq").desc()], MOST, "_n", where)
    hay = F.lower(F.concat_ws(" ", "text", "topic", F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ") if "tags" in notes.columns else F.lit("")))
    scored = recent.withColumn("score", overlap(note_tokens(F.lit(query)), hay)).filter("score > 0")
    return top_k_per(scored, list(SCOPE), [F.col("score").desc(), "_n"], clamp(limit, 20, 100)).drop("_n")


def recalled(requests: DataFrame, notes: DataFrame, limit: int) -> DataFrame:
    """(request_id, rank, score, note's columns) of requests (request_id, query, topic, session, scope), null for any.

    Of each request's scope, topic and session the newest `MOST` notes are looked at, as `search` does; a request without a
    query takes the newest, with the score null.
    """
    own = requests.select("request_id", F.nullif(F.trim("query"), F.lit("")).alias("_query"), F.col("topic").alias("_topic"), F.col("session").alias("_session"), *SCOPE)
    met = notes.join(own, list(SCOPE)).filter((F.col("_topic").isNull() | (F.col("topic") == F.col("_topic"))) & (F.col("_session").isNull() | (F.col("session") == F.col("_session"))))
    recent = top_k_per(met, ["request_id"], [F.col("ts").desc(), F.col("seq").desc()], MOST, "_n")
    tags = F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ") if "tags" in notes.columns else F.lit("")
    hay = F.lower(F.concat_ws(" ", "text", "topic", tags))
    scored = recent.withColumn("score", F.when(F.col("_query").isNotNull(), overlap(note_tokens(F.col("_query")), hay)))
    found = scored.filter(F.col("score").isNull() | (F.col("score") > 0))
    return top_k_per(found, ["request_id"], [F.col("score").desc(), "_n"], limit).select("request_id", "rank", "score", *notes.columns)
