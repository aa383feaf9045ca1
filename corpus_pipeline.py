"""From raw documents to token ids: the stages of the training-data pipeline.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the columns of documents; extra columns pass.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from larkspan.llm import bpe, exact_dedup, mixing, quality, similarity
from larkspan.llm.common import discard, new_path, table

_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """Documents are long: fewer rows go to a worker at once than Spark's default of 10,000, which saves memory on both sides."""
    spark.conf.set(_BATCH_ROWS, "1000")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from the labels, held-out ones apart, and the documents given."""
    _small_batches(spark)
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.keep_distinct(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id: texts whose five-word shingles have a similarity
    of 0.8 or more. SimHash fingerprints that differ in at most four bits name the first candidates, as in op8; whole sets
    decide, and an exact join finds the pairs that fingerprints miss; see the README."""
    _small_batches(spark)
    return similarity.keep_representatives(docs, shingle=5, max_bits=4)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: 0, 1 or 2 times."""
    return mixing.apply_mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of them and of what they decode to. Workers may still hold memory of the
    stages before, so less is remembered than by default."""
    _small_batches(spark)
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, remembered=100_000)


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", tokenize),
]

#: SQL can't express the classifier, the components of near copies and BPE; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents. A stage's table goes when the next one is written; the session's setting comes back."""
    docs, had = table(spark, sf_dir, "documents"), spark.conf.get(_BATCH_ROWS)
    try:
        for number, (_, stage) in enumerate(STAGES):
            path = new_path(spark, f"stage-{number}")
            stage(spark, docs, sf_dir).write.parquet(path)
            if number:
                discard(docs)
            docs = spark.read.parquet(path)
            docs._written = path
    finally:
        spark.conf.set(_BATCH_ROWS, had)
    return docs
