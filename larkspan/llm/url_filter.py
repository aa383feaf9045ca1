"""URL filters: longest-prefix rules, and logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import table
from larkspan.llm.url_labels import labelled_urls

#: (host, path start, verdict): the rules of the contract, fixed values.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

def host_and_path(url: str | None) -> tuple[str, str]:
    """Host: after the first :// up to a slash, question mark, hash or the end, A-Z lower-cased; path: from there on."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:end], rest[end:]
    stop = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:stop]


@dataclass(frozen=True)
class Regression:
    weight: np.ndarray
    bias: float
    grams: tuple[int, ...]

    def features(self, host: str, path: str) -> np.ndarray:
        return hashed(host, path, self.grams, len(self.weight))

    def probability(self, host: str, path: str) -> float:
        found = self.features(host, path)
        logit = self.bias + (self.weight[found].sum() / np.sqrt(len(found)) if len(found) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(logit, -60, 60))))


def hashed(host: str, path: str, grams: tuple[int, ...], buckets: int) -> np.ndarray:
    """Distinct buckets of the n-grams of ^host$ and ^path$, kept apart by a letter before them."""
    found = set()
    for kind, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        data = text.encode("utf-8", "surrogatepass")
        start = zlib.crc32(kind.encode())
        found.update(zlib.crc32(data[i : i + n], start) % buckets for n in grams for i in range(len(data) - n + 1))
    return np.fromiter(sorted(found), np.int64, len(found))


def train(rows: list[tuple[str, int]], grams: tuple[int, ...] = (3, 4, 5), buckets: int = 1 << 15, epochs: int = 60, rate: float = 2.0, shrink: float = 1e-2, seed: int = 3) -> Regression:
    """Stochastic gradient descent with weight decay; the same rows give the same weights. Without rows all is allowed."""
    model = Regression(np.zeros(buckets), -1.0 if not rows else 0.0, grams)
    weight, bias = model.weight, model.bias
    examples = [(model.features(*host_and_path(url)), label) for url, label in rows]
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        for k in rng.permutation(len(examples)):
            found, label = examples[k]
            scale = 1 / np.sqrt(max(1, len(found)))
            error = 1 / (1 + np.exp(-(bias + weight[found].sum() * scale))) - label
            step = rate / (1 + epoch / 10)
            weight[found] -= step * (error * scale + shrink * weight[found])
            bias -= step * error * 0.1
    return Regression(weight, float(bias), grams)


def rule_columns(host, path, rules) -> tuple:
    """(rule, verdict) of the longest rule that fits; of equally long ones the smaller string."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for own, start, says in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))[::-1]:
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule = F.when(fits, F.lit(own + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def judge_urls(pages: DataFrame, model: Regression, rules=RULES, id_col: str = "page_id", url_col: str = "url", least: float = 0.5) -> DataFrame:
    """id, host, path, rule, verdict and probability (that the method would block), for every row.

    Defined results: a url that is null or has no :// has an empty host and path, which no rule fits; ids may be null or
    repeat, rows are judged one by one; urls may have any length; of two rules of one length that fit, the smaller string
    wins; other columns, such as the page itself, are not read; an empty table gives an empty result.
    """
    after = F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.probability(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], ["id", "host", "path", "probability"])

    split = pages.select(F.col(id_col).cast("long").alias("id"), host.alias("host"), path.alias("path"))
    judged = split.mapInArrow(run, "id long, host string, path string, probability double")
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("probability") >= least, "block").otherwise("allow")
    return judged.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "probability")


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), train(labelled_urls()))
