"""Answers with citations from the pages of a question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.functions.text import density, meaningful_terms, newest_version, paragraphs, sentences
from larkspan.operators.ranking import diverse, with_rank


def passages(questions: DataFrame, sources: DataFrame) -> DataFrame:
    """(query_id, source, at, text, score) of questions (query_id, question) and their sources (query_id, source, content).

    A sentence scores 1.2 times its own density of the question's terms and 0.3 times its paragraph's; a paragraph without
    a sentence stands for itself.
    """
    terms = questions.select("query_id", meaningful_terms(F.col("question")).alias("terms"))
    each = sources.join(terms, "query_id").select("query_id", "source", "terms", F.posexplode(paragraphs(F.col("content"))).alias("p", "paragraph"))
    scored = each.withColumn("whole", density(F.col("paragraph"), F.col("terms"))).withColumn("parts", sentences(F.col("paragraph")))
    parts = F.when(F.size("parts") > 0, F.col("parts")).otherwise(F.array("paragraph"))
    found = scored.select("query_id", "source", "terms", "p", "whole", (F.size("parts") > 0).alias("split"), F.posexplode(parts).alias("s", "text"))
    score = F.when(F.col("split"), density(F.col("text"), F.col("terms")) * 1.2 + F.col("whole") * 0.3).otherwise(F.col("whole"))
    return found.select("query_id", "source", F.struct("source", "p", "s").alias("at"), "text", score.alias("score"))


def versions(questions: DataFrame, sources: DataFrame) -> DataFrame:
    """(query_id, source, name, major, minor, patch): the newest version each source names."""
    found = sources.withColumn("v", newest_version(F.col("content"))).filter("v IS NOT NULL")
    return found.join(questions, "query_id").select("query_id", "source", "v.name", "v.major", "v.minor", "v.patch")


def answers(questions: DataFrame, sources: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, answer): the best passages with their citations and the list of sources.

    sources: (query_id, source, url, title, content), source from 1. A question whose sources name a version is answered
    with the newest; else up to three passages, of which from the third on no source comes twice; else the first paragraph
    of the first source.
    """
    ranked = with_rank(passages(questions, sources).filter("score > 0"), ["query_id"], [F.col("score").desc(), "at"])
    chosen = diverse(ranked, ["query_id"], "source", "rank", most)
    cited = F.concat(F.rtrim("text"), F.lit(" [Source "), F.col("source").cast("string"), F.lit("]"))
    bodies = chosen.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", cited.alias("cited")))).alias("b")).select("query_id", F.array_join(F.transform("b", lambda x: x["cited"]), " ").alias("body"))
    label = F.concat(F.col("name"), F.lit(" "), F.col("major").cast("string"), F.lit("."), F.col("minor").cast("string"), F.when(F.col("patch") > 0, F.concat(F.lit("."), F.col("patch").cast("string"))).otherwise(""))
    newest = with_rank(versions(questions, sources), ["query_id"], [F.col("major").desc(), F.col("minor").desc(), F.col("patch").desc(), F.col("source").desc()]).filter("rank = 1")
    newest = newest.select("query_id", F.concat(F.lit("The latest "), F.col("name"), F.lit(" version found in the fetched pages is **"), label, F.lit("**. [Source "), F.col("source").cast("string"), F.lit("]")).alias("version"))
    line = F.concat(F.lit("Source "), F.col("source").cast("string"), F.lit(": "), F.col("url"), F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit(" ("), F.col("title"), F.lit(")"))).otherwise(""))
    fallback = F.coalesce(F.get(paragraphs(F.col("content")), F.lit(0)), F.substring("content", 1, 300))
    listed = sources.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("source", line.alias("line")))).alias("l"), F.min_by(fallback, "source").alias("first"))
    out = questions.select("query_id").join(listed, "query_id", "left").join(bodies, "query_id", "left").join(newest, "query_id", "left")
    body = F.coalesce("version", "body", F.trim("first"))
    text = F.concat(F.lit("Answer: "), body, F.lit("\n\nSources:\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    return out.select("query_id", F.coalesce(text, F.lit("Answer: Could not extract a specific answer from the content.\n\nSources: (none)")).alias("answer"))
