"""Exact dedup by a tree-merge of sorted digest runs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import discard, fresh, materialize, text_or_empty

KEY = ["digest", "n_bytes", "check"]


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(tag, doc, digest, n_bytes, check): tag tells rows apart, whatever ids repeat, and begins with the partition's number."""
    text = text_or_empty(text_col)
    rows = docs.select(
        F.monotonically_increasing_id().alias("tag"),
        F.col(id_col).alias("doc"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length(text).alias("n_bytes"),
        F.xxhash64(text).alias("check"),
    )
    return materialize(rows, "digests")


def sorted_runs(rows: DataFrame, runs: int, largest: bool) -> DataFrame:
    """(run, digest, n_bytes, check, best, group_size): one entry for each text of a run.

    A run is what some of the partitions hold. The identifier that stays is a struct, for which Spark sorts a run by its
    key and folds neighbours, before the exchange as after it; so a text that a third of all rows share moves as one
    entry a task.
    """
    own = F.struct((F.lit(False) if largest else F.col("doc").isNull()).alias("last"), "doc", "tag")
    run = F.pmod(F.shiftright("tag", 33), F.lit(runs)).cast("int")
    return rows.groupBy(run.alias("run"), *KEY).agg((F.max if largest else F.min)(own).alias("best"), F.count("*").alias("group_size"))


def merged(level: DataFrame, stride: int, fan_in: int, largest: bool) -> DataFrame:
    """One round: the runs at 1, 2, .. (fan_in - 1) strides behind a run are sent to it. Spark sorts what meets by the verified
    key (digest, length and a second, independent hash) and folds neighbours; of an entry that several runs have, the best
    identifier and the sum stay."""
    behind = F.pmod(F.floor(F.col("run") / stride), F.lit(fan_in))
    sent = level.withColumn("run", (F.col("run") - behind * stride).cast("int"))
    return sent.groupBy("run", *KEY).agg((F.max if largest else F.min)("best").alias("best"), F.sum("group_size").alias("group_size"))


def merge_tree(level: DataFrame, runs: int, fan_in: int, largest: bool) -> DataFrame:
    """Rounds of a tree, each a merge of `fan_in` runs by one exchange. Each round ends in a table, so a lost executor costs no
    earlier round."""
    stride = 1
    while stride < runs:
        last, level = level, materialize(merged(level, stride, fan_in, largest), f"runs-{stride}")
        discard(last)
        stride *= fan_in
    return level.drop("run")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", runs: int = 16, fan_in: int = 4) -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept and text_sha256; texts are equal when identical.

    Defined results: a null text counts as empty and empty texts are one group; a null id stays only where its group has
    no other id; rows that repeat both id and text all count in group_size and exactly one of them is kept; other
    columns of `docs`, whatever their names, are not read; texts of any length are hashed whole; an empty table gives an
    empty result.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    if fan_in < 2 or runs < 1:
        raise ValueError("fan_in is 2 or more, runs 1 or more")
    largest = keep == "largest"
    rows = digests(docs, id_col, text_col)
    level = materialize(sorted_runs(rows, runs, largest), "runs")
    groups = merge_tree(level, runs, fan_in, largest).filter("group_size > 1")
    groups = groups.select(*KEY, F.col("best.doc").alias("keep_id"), F.col("best.tag").alias("keep_tag"), "group_size")
    alone = F.col("group_size").isNull()
    return rows.join(groups, KEY, "left").select(
        F.col("doc").alias(id_col),
        F.when(alone, F.col("doc")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("tag") == F.col("keep_tag"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of `docs` that `exact_dedup` keeps, with all their columns."""
    marks = exact_dedup(docs.select(id_col, text_col), id_col, text_col, keep)
    own, sha, rows_of = fresh(docs, "_kept_id", "_kept_sha", "_kept_rows")
    kept = marks.groupBy(F.col(id_col).alias(own), F.col("text_sha256").alias(sha)).agg(F.max("kept").alias("stays"), F.count("*").alias(rows_of))
    kept = kept.filter("stays").drop("stays")
    same = docs[id_col].eqNullSafe(kept[own]) & (F.sha2(text_or_empty(text_col), 256) == kept[sha])
    rows = docs.join(kept, same)
    once = rows.filter(F.col(rows_of) == 1).select(docs.columns)
    return once.unionAll(rows.filter(F.col(rows_of) > 1).dropDuplicates([own, sha]).select(docs.columns))


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from larkspan.llm.common import table

    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)
"""
