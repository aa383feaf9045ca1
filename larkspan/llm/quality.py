"""Quality classifier: supervised subword embeddings averaged per document, softmax output, trained by numpy SGD."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import table, text_or_empty


@dataclass(frozen=True)
class Settings:
    """buckets (a power of two), width: of the table of vectors; grams: lengths of character n-grams; sample: labelled rows
    of a class to train on at most, each with all of its features; rate, pull: step sizes of the output layer and of the
    vectors, whose gradient a document's many features share."""

    buckets: int = 1 << 16
    width: int = 16
    grams: tuple[int, ...] = (2, 3, 4)
    sample: int = 1000
    epochs: int = 6
    rate: float = 0.5
    pull: float = 20.0
    seed: int = 7


SETTINGS = Settings()
#: The base of the hashes, an odd number.
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _spread(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(kind)
    return h ^ (h >> np.uint64(32))


def word_features(words: pa.Array, settings: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of words, buckets) of the features of words: first the word itself, then the character n-grams of <word>.

    All words' characters lie in one array; the hash of a stretch is a polynomial of its characters. Words may have any
    length; a feature that a word has twice comes twice.
    """
    marked = pc.binary_join_element_wise(pa.scalar("<", words.type), words, pa.scalar(">", words.type), pa.scalar("", words.type))
    lengths = pc.utf8_length(marked).to_numpy().astype(np.int64)
    codes = np.frombuffer("".join(marked.to_pylist()).encode("utf-32-le"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    start = np.cumsum(lengths) - lengths
    place = np.arange(len(codes)) - start[owner]
    low = np.uint64(settings.buckets - 1)
    with np.errstate(over="ignore"):
        powers = np.full(int(lengths.max(initial=1)), _BASE, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        whole = np.add.reduceat(codes * powers[place], start) if len(words) else codes
        yield np.arange(len(words)), (_spread(whole, 1) & low).astype(np.int64)
        left = lengths[owner] - place
        for n in settings.grams:
            count = len(codes) - n + 1
            if count <= 0:
                continue
            h = np.zeros(count, np.uint64)
            for k in range(n):
                h = h * _BASE + codes[k : k + count]
            inside = left[:count] >= n
            yield owner[:count][inside], (_spread(h[inside], n) & low).astype(np.int64)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, the number of each word of the texts in order, bounds of each text in these)."""
    split = pc.utf8_split_whitespace(texts)
    coded = pc.dictionary_encode(split.flatten())
    bounds = np.r_[0, np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
    filled = coded.dictionary.filter(pc.not_equal(coded.dictionary, "")) if len(coded.dictionary) else coded.dictionary
    if len(filled) == len(coded.dictionary):
        return filled, coded.indices.to_numpy(), bounds
    # White space at either end leaves empty words, which aren't any.
    number = pc.index_in(coded.dictionary, filled).fill_null(-1).to_numpy()[coded.indices.to_numpy()]
    real = number >= 0
    return filled, number[real], np.r_[0, np.cumsum(real)][bounds]


def pair_features(buckets: np.ndarray, number: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of first words, buckets) of the word 2-grams within texts: the hash of a pair, whatever its order, is the
    exclusive or of its words' hashes. Rare pairs share buckets at random; pairs of equal words all have the same one."""
    if len(number) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.ones(len(number) - 1, bool)
    ends = bounds[1:-1]
    first[ends[(ends > 0) & (ends < len(number))] - 1] = False
    at = np.flatnonzero(first)
    return at, buckets[number[at]] ^ buckets[number[at + 1]]


def document_features(text: str, settings: Settings) -> Counter:
    """How often the text has each bucket, in ascending order of buckets."""
    words, number, bounds = words_of(pa.array([text], pa.string()))
    times = np.bincount(number, minlength=len(words))
    counts = np.zeros(settings.buckets, np.int64)
    for kind, (owner, bucket) in enumerate(word_features(words, settings)):
        counts += np.bincount(bucket, weights=times[owner], minlength=settings.buckets).astype(np.int64)
        if not kind:
            counts += np.bincount(pair_features(bucket, number, bounds)[1], minlength=settings.buckets)
    found = np.flatnonzero(counts)
    return Counter(dict(zip(found.tolist(), counts[found].tolist(), strict=True)))


@dataclass(frozen=True)
class Model:
    """What a feature adds to the logit of label 1, and the bias; the logit is the mean of a document's features."""

    weight: np.ndarray
    bias: float
    settings: Settings


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], settings: Settings) -> Model:
    """examples: (features, shares that sum to 1, label). One label only, or none, gives a constant score."""
    labels = Counter(label for _, _, label in examples)
    if len(labels) < 2:
        bias = 0.0 if not labels else (3.0 if 1 in labels else -3.0)
        return Model(np.zeros(settings.buckets), bias, settings)
    rng = np.random.default_rng(settings.seed)
    vectors = rng.uniform(-1 / settings.width, 1 / settings.width, (settings.buckets, settings.width))
    out, bias = np.zeros((2, settings.width)), np.zeros(2)
    steps = settings.epochs * len(examples)
    step = 0
    for _ in range(settings.epochs):
        for k in rng.permutation(len(examples)):
            features, shares, label = examples[k]
            left = 1 - step / steps
            step += 1
            hidden = shares @ vectors[features] if len(features) else np.zeros(settings.width)
            logits = out @ hidden + bias
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[label] -= 1
            back = out.T @ error
            out -= settings.rate * left * np.outer(error, hidden)
            bias -= settings.rate * left * error
            if len(features):
                # Features of a document are distinct, so a plain subtraction reaches each of them once.
                vectors[features] -= (settings.pull * left * shares)[:, None] * back
    return Model(vectors @ (out[1] - out[0]), float(bias[1] - bias[0]), settings)


#: Bytes of text that are scored together.
BATCH = 2 << 20


class Scorer:
    """Scores texts together: what each distinct word adds is found by array operations, then summed over each text."""

    def __init__(self, model: Model):
        self.model = model

    def _some(self, texts: pa.Array) -> np.ndarray:
        words, number, bounds = words_of(texts)
        added, features = np.zeros(len(words)), np.zeros(len(words))
        pairs = np.zeros(len(number)), np.zeros(len(number))
        for kind, (owner, bucket) in enumerate(word_features(words, self.model.settings)):
            added += np.bincount(owner, self.model.weight[bucket], len(words))
            features += np.bincount(owner, minlength=len(words))
            if not kind:
                at, of_pair = pair_features(bucket, number, bounds)
                pairs[0][at], pairs[1][at] = self.model.weight[of_pair], 1
        # Sums over a text's words in order, so that a score follows from the text alone.
        sums = [np.zeros(len(texts)) for _ in range(2)]
        some = np.flatnonzero(bounds[1:] > bounds[:-1])
        for total, values, more in zip(sums, (added, features), pairs, strict=True):
            if len(some):
                total[some] = np.add.reduceat(values[number] + more, bounds[some])
        logit = self.model.bias + sums[0] / np.maximum(sums[1], 1)
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))

    def scores(self, texts: pa.Array) -> np.ndarray:
        bound = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        out, first = [], 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(bound, (bound[first - 1] if first else 0) + BATCH, "right")))
            out.append(self._some(texts.slice(first, last - first)))
            first = last
        return np.concatenate(out) if out else np.empty(0)

    def score(self, text: str) -> float:
        return float(self.scores(pa.array([text], pa.string()))[0])


def held_out(id_col: str):
    """Rows whose labels are never learnt from; a null id has the text null, so it is not one of them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = SETTINGS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Train on a bounded sample: of each label the `settings.sample` ids with the smallest hash, held-out ids apart.

    The ids alone go to the driver first; the texts they name become feature counts where they are read. Labels other
    than 0 and 1, and null ids, are not used; of several labels of an id the least counts.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    chosen = []
    for label in (0, 1):
        chosen += [tuple(r) for r in known.filter(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(settings.sample).collect()]
    if not chosen:
        return train([], settings)
    spark = docs.sparkSession
    sample = F.broadcast(spark.createDataFrame(chosen, "id long, label int"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = document_features(text, settings)
                packed = (np.fromiter(x, "<u4", len(found)).tobytes() for x in (found.keys(), found.values()))
                yield pa.RecordBatch.from_arrays([pa.array([doc]), pa.array([label], pa.int32()), *(pa.array([x]) for x in packed)], ["id", "label", "features", "counts"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).join(sample, "id").select("id", "label", "text")
    rows = texts.mapInArrow(features, "id long, label int, features binary, counts binary").collect()
    examples = []
    for row in sorted(rows, key=lambda r: (r.id, bytes(r.features), bytes(r.counts))):
        counts = np.frombuffer(row.counts, "<u4").astype(np.float32)
        examples.append((np.frombuffer(row.features, "<u4"), counts / counts.sum() if len(counts) else counts, row.label))
    return train(examples, settings)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted for every row; a row's score follows from its whole text alone.

    Null counts as empty; an empty text has the score that the bias gives; a score of just 0.5 predicts 1; repeated rows
    get equal results; texts and words may have any length; other columns are not read; an empty table gives an empty
    result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scorer.scores(batch.column(2)))], ["id", "held_out", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"), text_or_empty(text_col).alias("text"))
    scored = source.mapInArrow(run, "id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of `docs` with a score of `least` or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(scorer.scores(pc.fill_null(batch.column(at), "")) >= least))

    return docs.mapInArrow(run, docs.schema)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
