"""Re-ranking of results by likeness or by a scorer."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspan.operators.ranking import top_k_per

SEMANTIC, FUSION = 0.7, 0.3


def blend(rows: DataFrame, k: int) -> DataFrame:
    """The first k of (query_id, hit_id, sim, fusion) by 0.7 times likeness and 0.3 times the fusion score's share of the
    greatest; by likeness alone where no fusion score is above 0."""
    most = F.max("fusion").over(Window.partitionBy("query_id"))
    blended = F.when(most > 0, SEMANTIC * F.col("sim") + FUSION * F.col("fusion") / most).otherwise(F.col("sim"))
    return top_k_per(rows.withColumn("blended", F.round(blended, 6)), ["query_id"], [F.col("blended").desc(), "hit_id"], k)


def rerank(rows: DataFrame, text: str, scorer: Callable[[list[str]], list[float]], keys: Sequence[str], ties: Sequence[str], k: int) -> DataFrame:
    """The first k of each key by a scorer of texts, which works on Arrow batches."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(scorer(texts.tolist()), dtype="float64")

    return top_k_per(rows.withColumn("score", score(F.col(text))), keys, [F.col("score").desc(), *ties], k)


def normalise_scores(outputs: Column, expected: int) -> Column:
    """One score for each text from a model's outputs, arrays of logits: the greatest of each, zeros for what is missing."""
    best = F.transform(outputs, lambda x: F.array_max(x))
    return F.slice(F.concat(best, F.array_repeat(F.lit(0.0), expected)), 1, expected)


def hash_vector(text: str | None, width: int = 64) -> list[float]:
    """Counts of hashed words, of length one; zeros for a text without words."""
    counts = [0.0] * width
    for word in re.findall(r"\w+", (text or "").lower()):
        counts[zlib.crc32(word.encode("utf-8", "surrogatepass")) % width] += 1
    size = sum(x * x for x in counts) ** 0.5
    return [x / size for x in counts] if size else counts


def hash_embedding(text: Column, width: int = 64) -> Column:
    """A deterministic embedding for where no model is there."""
    return F.udf(lambda t: hash_vector(t, width), "array<double>", useArrow=True)(text)
