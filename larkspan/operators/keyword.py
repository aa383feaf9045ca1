"""Keyword search: postings, corpus statistics and BM25."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions.text import fts_terms, index_tokens
from larkspan.operators.best import Best
from larkspan.operators.inverted import B, K1, InvertedIndex
from larkspan.operators.ranking import top_k_per
from larkspan.tables import materialize


def postings(texts: DataFrame) -> DataFrame:
    """(hit_id, term, tf, doc_len) of (hit_id, text)."""
    tokens = texts.select("hit_id", index_tokens(F.col("text")).alias("tokens")).withColumn("doc_len", F.size("tokens"))
    return tokens.select("hit_id", "doc_len", F.explode("tokens").alias("term")).groupBy("hit_id", "doc_len", "term").agg(F.count("*").alias("tf"))


def statistics(texts: DataFrame) -> DataFrame:
    """One row: number of texts and their average length in tokens, over the whole index."""
    return texts.agg(F.count("*").alias("n_texts"), F.avg(F.size(index_tokens(F.col("text")))).alias("avg_len"))


def query_phrases(queries: DataFrame) -> DataFrame:
    """(query_id, phrases): what a query asks for, each a struct of tokens and whether the last of them is a prefix.

    A term that the index cuts further is a phrase of its parts, which a text must have one after the other; the last term
    of a query is a prefix.
    """
    terms = queries.select("query_id", fts_terms(F.col("text")).alias("terms"))
    each = F.transform("terms", lambda t, i: F.struct(index_tokens(t).alias("tokens"), (i == F.size("terms") - 1).alias("prefix")))
    return terms.select("query_id", F.filter(each, lambda p: F.size(p["tokens"]) > 0).alias("phrases"))


class Asked:
    """The phrases that a block of queries asks for, numbered: the tokens that matter, and each query's phrases."""

    def __init__(self, rows: list):
        self.ids = [r["query_id"] for r in rows]
        self.groups = np.array([r["grp"] for r in rows], object)
        numbers: dict[tuple[tuple[str, ...], bool], int] = {}
        self.wanted: list[tuple[np.ndarray, np.ndarray]] = []
        for row in rows:
            own = [numbers.setdefault((tuple(p["tokens"]), p["prefix"]), len(numbers)) for p in row["phrases"] or ()]
            self.wanted.append(np.unique(np.array(own, np.int64), return_counts=True))
        self.phrases = list(numbers)
        single = [(p[0], i) for i, (p, prefix) in enumerate(self.phrases) if len(p) == 1 and not prefix]
        self.single = pa.array([t for t, _ in single], pa.string()), np.array([i for _, i in single], np.int64)
        #: By length of the prefix: the prefixes and the numbers of their phrases.
        self.begun: dict[int, tuple[pa.Array, np.ndarray]] = {}
        prefixes = [(p[0], i) for i, (p, prefix) in enumerate(self.phrases) if len(p) == 1 and prefix]
        for length in sorted({len(t) for t, _ in prefixes}):
            here = [(t, i) for t, i in prefixes if len(t) == length]
            self.begun[length] = pa.array([t for t, _ in here], pa.string()), np.array([i for _, i in here], np.int64)
        self.longer = [(i, p, prefix) for i, (p, prefix) in enumerate(self.phrases) if len(p) > 1]

    def frequencies(self, tokens: pa.Array, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents, phrases, how often) of the tokens of documents in order."""
        coded = tokens.dictionary_encode()
        own, at = coded.dictionary, coded.indices.to_numpy()
        found: list[np.ndarray] = []
        places = [(own, *self.single)] + [(pc.utf8_slice_codeunits(own, 0, n), *x) for n, x in self.begun.items()]
        for words, terms, numbers in places:
            hit = pc.index_in(words, terms).fill_null(-1).to_numpy()[at]
            here = np.flatnonzero(hit >= 0)
            found.append(doc[here] * len(self.phrases) + numbers[hit[here]])
        for number, parts, prefix in self.longer:
            match = np.ones(max(0, len(at) - len(parts) + 1), bool)
            for k, part in enumerate(parts):
                same = pc.starts_with(own, part) if prefix and k == len(parts) - 1 else pc.equal(own, part)
                match &= same.to_numpy(zero_copy_only=False)[at[k : k + len(match)]]
            if len(match):
                match &= doc[: len(match)] == doc[len(parts) - 1 :]
                found.append(doc[: len(match)][match] * len(self.phrases) + number)
        keys, counts = np.unique(np.concatenate(found), return_counts=True)
        return keys // max(1, len(self.phrases)), keys % max(1, len(self.phrases)), counts


def keyword_top(queries: DataFrame, texts: DataFrame | InvertedIndex, k: int, where: Column | None = None, same_group: bool = False, block: int = 4096) -> DataFrame:
    """(query_id, hit_id, score, rank): the k texts with the highest BM25 of each query, rounded to six places, then by id.

    queries: (query_id, text[, grp]), texts: (hit_id, text[, grp] and what `where` needs). `where`, and with same_group the
    group, say which texts a query may see before anything is ranked; the statistics are those of the whole index. A text
    without any of a query's phrases is no hit.

    Queries go to the executors in blocks of bounded size. Each block reads the texts once and keeps, beside each, how often
    it has the phrases asked for; no row for a query and a text is made but the k best of a task.
    """
    if isinstance(texts, InvertedIndex):
        return texts.search(queries, k, where, same_group, block)
    phrases = query_phrases(queries)
    asked = materialize(phrases if not same_group else phrases.join(queries.select("query_id", F.col("grp").cast("string").alias("grp")), "query_id"), "asked")
    blocks = max(1, -(-asked.count() // block))
    seen = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    group = F.col("grp").cast("string") if same_group else F.lit(None).cast("string")
    pool = texts.select("hit_id", index_tokens(F.coalesce("text", F.lit(""))).alias("tokens"), group.alias("grp"), seen.alias("seen"))
    out = None
    for number in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number) if blocks > 1 else asked
        own = own if same_group else own.withColumn("grp", F.lit(None).cast("string"))
        found = _block(pool, own, k, same_group)
        out = found if out is None else out.unionByName(found)
    return top_k_per(out, ["query_id"], [F.col("score").desc(), "hit_id"], k)


def _block(pool: DataFrame, own: DataFrame, k: int, same_group: bool) -> DataFrame:
    spark = pool.sparkSession
    hit_type, query_type = pool.schema["hit_id"].dataType.simpleString(), own.schema["query_id"].dataType.simpleString()
    sent = spark.sparkContext.broadcast(Asked(own.orderBy("query_id").collect()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(1)
            sizes = tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            doc, phrase, times = sent.value.frequencies(tokens.flatten(), np.repeat(np.arange(len(sizes)), sizes))
            bounds = pa.array(np.searchsorted(doc, np.arange(len(sizes) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32))) for x in (phrase, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), batch.column(2), batch.column(3), *lists], ["hit_id", "size", "grp", "seen", "phrases", "times"])

    counted = materialize(pool.mapInArrow(count, f"hit_id {hit_type}, size long, grp string, seen boolean, phrases array<int>, times array<int>"), "frequencies")
    n_texts, tokens = counted.agg(F.count("*"), F.sum("size")).first()
    frequent = counted.select(F.explode("phrases").alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n")).collect()
    average = (tokens or 0) / n_texts if n_texts else 0.0
    told = spark.sparkContext.broadcast((n_texts, average, {r.phrase: r.n for r in frequent}))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, (n, average, documents) = sent.value, told.value
        best = Best(k)
        frequency = np.array([documents.get(i, 0) for i in range(len(asked.phrases))], float)
        idf = np.maximum(np.log((n - frequency + 0.5) / (frequency + 0.5)), 1e-6)
        for batch in batches:
            batch = batch.filter(batch.column(3))
            size, lengths = batch.column(1).to_numpy().astype(float), batch.column(4).value_lengths().to_numpy(zero_copy_only=False)
            phrase, times = batch.column(4).flatten().to_numpy(), batch.column(5).flatten().to_numpy().astype(float)
            doc = np.repeat(np.arange(len(size)), lengths)
            part = idf[phrase] * times * (K1 + 1) / (times + K1 * (1 - B + B * size[doc] / average)) if len(doc) else times
            order = np.argsort(phrase, kind="stable")
            doc, part, phrase = doc[order], part[order], phrase[order]
            starts = np.searchsorted(phrase, np.arange(len(asked.phrases) + 1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            groups = np.array(batch.column(2).to_pylist(), object) if same_group else None
            for query, (wanted, often) in enumerate(asked.wanted):
                at = [slice(starts[p], starts[p + 1]) for p in wanted]
                met = np.concatenate([doc[s] for s in at]) if at else doc[:0]
                if not len(met):
                    continue
                score = np.bincount(met, np.concatenate([part[s] * o for s, o in zip(at, often, strict=True)]), len(size))
                hits = np.flatnonzero(score)
                if same_group:
                    hits = hits[groups[hits] == asked.groups[query]]
                if not len(hits):
                    continue
                rounded = np.round(score[hits], 6)
                best.add_matrix(np.array([query]), ids[hits], rounded[None, :])
        query, ids, score = best.rows()
        if len(query):
            yield pa.RecordBatch.from_arrays([pa.array([asked.ids[q] for q in query]), pa.array(ids), pa.array(score, pa.float64())], ["query_id", "hit_id", "score"])

    return counted.mapInArrow(rank, f"query_id {query_type}, hit_id {hit_type}, score double")
