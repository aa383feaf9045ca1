"""A stored inverted index: built once, extended by segments, searched without reading the texts again.

Layout under a folder, each table partitioned by `segment`, a number for each time texts were added:

- `postings`, by `bucket`, a hash of the term: a row for each term of a shard, with the documents that have it, how often, and at
  which places, and, if they are more than BLOCK, for each block of BLOCK documents the most frequent occurrence and the shortest text, from which
  a bound on the block's scores follows at any later average length.
- `lexicon`: the terms of a segment, for what begins like a query's last word.
- `docs`: hit_id, shard, number in the shard, length in tokens, group and attributes. It is written last; segments without
  it don't exist.
- `deleted`: ids, and the segment from which on they may be there again.

A shard is what one task of the build met, up to SHARD tokens; its documents are numbered by id. So no text is shuffled
to build an index, and a search sends only the postings of the terms asked for, a shard to a task.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions.text import index_tokens
from larkspan.operators.ranking import top_k_per
from larkspan.tables import dropped, materialize

K1, B = 1.2, 0.75
BLOCK, SHARD, BUCKETS = 128, 1_000_000, 32
#: Bytes of terms that are sent to every task at most.
SENT = 32 << 20
#: Scores are rounded to six places before they are compared, so bounds must be this much below a cutoff to count as below.
_SLACK = 2e-6
_LISTS = ("docs", "times", "places", "most", "least")
_POSTINGS = "shard long, bucket int, term string, widths int, " + ", ".join(f"{c} binary" for c in _LISTS)


def bucket_of(term: str) -> int:
    return zlib.crc32(term.encode()) % BUCKETS


def packed(bounds: np.ndarray, values: np.ndarray) -> tuple[pa.Array, int]:
    """(lists of whole numbers as binaries, bytes of a number): of the narrowest unsigned type that holds them all. Binaries
    cross to and from Python at a fraction of lists' cost."""
    width = next(w for w in (1, 2, 4) if not len(values) or values.max() < 1 << 8 * w)
    offsets, data = np.ascontiguousarray(width * bounds, "<i4"), np.ascontiguousarray(values, f"<u{width}")
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]), width


def unpacked(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(all values, bounds of each row's): of null rows there are none."""
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, "<i4")[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, "<i4")
    size = int(bounds[-1] - bounds[0])
    values = np.frombuffer(data, "u1", size, int(bounds[0])).view(f"<u{width}") if size else np.empty(0)
    return values.astype(np.int64), (bounds - bounds[0]) // width


def widths_of(code: int) -> list[int]:
    """The bytes of a number in each of `_LISTS`; a shard's are the same in all its rows."""
    return [code >> 4 * n & 15 for n in range(len(_LISTS))]


class ShardBuilder:
    """Gathers the tokens of documents and gives a shard's postings."""

    def __init__(self):
        self.ids: list[pa.Array] = []
        self.tokens: list[pa.Array] = []
        self.others: list[pa.RecordBatch] = []
        self.size = 0

    def add(self, ids: pa.Array, tokens: pa.Array, others: pa.RecordBatch) -> None:
        self.ids.append(ids)
        self.tokens.append(tokens)
        self.others.append(others)
        self.size += len(tokens.flatten())

    def made(self) -> tuple[pa.Array, np.ndarray, pa.Table, pa.Array, int, list[pa.Array]]:
        """(ids in order, lengths, other columns, terms, widths, their lists)."""
        ids = pa.concat_arrays(self.ids)
        order = pc.sort_indices(ids)
        lists = pa.concat_arrays(self.tokens).take(order)
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        by_term = np.argsort(codes, kind="stable")
        doc = np.repeat(np.arange(len(lengths)), lengths)[by_term]
        place = (np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths))[by_term]
        codes = codes[by_term]
        # A posting is a run of equal (term, document), a term's list a run of postings, a block up to BLOCK of them.
        first = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (doc[1:] != doc[:-1])]) if len(codes) else codes
        times = np.diff(np.r_[first, len(codes)])
        of_term, docs = codes[first], doc[first]
        starts = np.searchsorted(of_term, np.arange(len(coded.dictionary) + 1))
        within = np.arange(len(docs)) - starts[of_term]
        blocks = np.flatnonzero(within % BLOCK == 0)
        most = np.maximum.reduceat(times, blocks) if len(blocks) else times
        least = np.minimum.reduceat(lengths[docs], blocks) if len(blocks) else times
        # A list of one block says its maxima itself.
        count = np.diff(np.searchsorted(blocks, starts))
        several = (count > 1)[of_term[blocks]]
        at_tokens, at_blocks = np.r_[first, len(codes)][starts], np.r_[0, np.cumsum(np.where(count > 1, count, 0))]
        most, least = most[several], least[several]
        lists = [packed(*x) for x in ((starts, docs), (starts, times), (at_tokens, place), (at_blocks, most), (at_blocks, least))]
        code = sum(width << 4 * n for n, (_, width) in enumerate(lists))
        return ids.take(order), lengths, pa.Table.from_batches(self.others).take(order), coded.dictionary, code, [column for column, _ in lists]


def _segment_rows(texts: DataFrame, attrs: list[str]) -> DataFrame:
    """Postings (`_POSTINGS`) and, where term is null, documents: doc, hit_id, size, grp and attributes."""
    grp = F.col("grp").cast("string") if "grp" in texts.columns else F.lit(None).cast("string")
    source = texts.select("hit_id", index_tokens(F.coalesce("text", F.lit(""))).alias("tokens"), grp.alias("grp"), *attrs)
    own = [f for f in source.schema if f.name not in ("tokens",)]
    schema = _POSTINGS + ", doc int, size int, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)
    most = SHARD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, builder = TaskContext.get().partitionId(), 0, ShardBuilder()

        def shard() -> Iterator[pa.RecordBatch]:
            ids, lengths, others, terms, code, lists = builder.made()
            name = (task << 24) + number
            kinds = [others.schema.field(i).type for i in range(others.num_columns)]
            ints = pa.int32()
            names = ["shard", "bucket", "term", "widths", *_LISTS, "doc", "size", *others.schema.names]
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, name)), pa.nulls(n, ints), pa.nulls(n, pa.string()), pa.nulls(n, ints), *[pa.nulls(n, pa.binary())] * 5, pa.array(np.arange(n), ints), pa.array(lengths, ints), *(c.combine_chunks() for c in others.columns)], names)
            for i in range(0, len(terms), 4096):
                part = terms.slice(i, 4096)
                m = len(part)
                buckets = pa.array([bucket_of(t) for t in part.to_pylist()], ints)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, name)), buckets, part.cast(pa.string()), pa.array(np.full(m, code), ints), *(c.slice(i, 4096) for c in lists), pa.nulls(m, ints), pa.nulls(m, ints), *(pa.nulls(m, k) for k in kinds)], names)

        for batch in batches:
            others = batch.drop_columns(["tokens"])
            # A batch is cut where the shard is full; a longer text is a shard of its own.
            ends = np.cumsum(batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            first = 0
            while first < len(batch):
                before = ends[first - 1] if first else 0
                last = max(first + (builder.size == 0), int(np.searchsorted(ends, before + most - builder.size, "right")))
                if last > first:
                    builder.add(batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), others.slice(first, last - first))
                if last < len(batch):
                    yield from shard()
                    number, builder = number + 1, ShardBuilder()
                first = last
        if builder.ids:
            yield from shard()

    return source.mapInArrow(run, schema)


def gathered(values: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The lists of these rows one after the other."""
    size = bounds[rows + 1] - bounds[rows]
    ends = np.cumsum(size)
    return values[np.repeat(bounds[rows] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Lists:
    """What a block's phrases find in a shard: for each the documents and how often, from the postings of its terms."""

    def __init__(self, asked, live: np.ndarray, sizes: np.ndarray):
        self.asked, self.live, self.sizes = asked, live, sizes
        #: By length of a beginning, 0 for whole terms: what to look for, and the places in phrases that want it.
        self.wanted: dict[int, dict[str, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for number, (parts, prefix) in enumerate(asked.phrases):
            for place, part in enumerate(parts):
                self.wanted[len(part) if prefix and place == len(parts) - 1 else 0][part].append((number, place))
        #: For each place in a phrase: columns of postings, and the rows of them that it met.
        self.found: dict[tuple[int, int], list[tuple[list, np.ndarray]]] = defaultdict(list)

    def add(self, terms: pa.Array, columns: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """columns: `_LISTS` of these terms, unpacked."""
        for length, words in self.wanted.items():
            own = pc.utf8_slice_codeunits(terms, 0, length) if length else terms
            hit = pc.index_in(own, pa.array(words, terms.type)).fill_null(-1).to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(hit >= 0)
            rows = rows[np.argsort(hit[rows], kind="stable")]
            keys = list(words.values())
            for part in np.split(rows, np.flatnonzero(np.diff(hit[rows])) + 1) if len(rows) else ():
                for key in keys[hit[part[0]]]:
                    self.found[key].append((columns, part))

    def _list(self, key: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Documents and how often, one posting's after the other's."""
        return tuple(np.concatenate([gathered(*columns[n], rows) for columns, rows in self.found[key]]) for n in (0, 1))

    def phrases(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(phrase, live documents in order, how often they have it, and of each block the most often and the least size). The
        stored maxima serve where the list is a stored one."""
        for number, (parts, _) in enumerate(self.asked.phrases):
            keys = [(number, place) for place in range(len(parts))]
            if not all(key in self.found for key in keys):
                continue
            if len(parts) > 1:
                docs, times = self._together(keys)
            else:
                docs, times = self._list(keys[0])
                if sum(len(rows) for _, rows in self.found[keys[0]]) == 1:
                    (columns, rows), = self.found[keys[0]]
                    if len(most := gathered(*columns[3], rows)) and self.live[docs].all():
                        yield number, docs, times, most, gathered(*columns[4], rows)
                        continue
                else:
                    docs, at = np.unique(docs, return_inverse=True)
                    times = np.bincount(at, times).astype(np.int64)
            alive = self.live[docs]
            if alive.any():
                yield number, docs[alive], times[alive], *maxima(docs[alive], times[alive], self.sizes)

    def _together(self, keys: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Documents that have a token of each place one behind the other."""
        both = None
        for place, key in enumerate(keys):
            docs, times = self._list(key)
            places = np.concatenate([gathered(*columns[2], rows) for columns, rows in self.found[key]])
            spots = np.unique(np.repeat(docs, times) * (1 << 32) + places + len(keys) - place)
            both = spots if both is None else np.intersect1d(both, spots)
        return np.unique(both >> 32, return_counts=True)


def maxima(docs: np.ndarray, times: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each block of a list how often its documents have it at most, and the size of the shortest."""
    at = np.arange(0, len(docs), BLOCK)
    return np.maximum.reduceat(times, at), np.minimum.reduceat(sizes[docs], at)


def stretches(values: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the stretches of equal values."""
    cut = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
    return [(i, j) for i, j in zip(cut, cut[1:], strict=False) if j > i]


def _flat(array: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(array, kind).tobytes()


_COUNTED = "phrases array<int>, counts array<int>, docs binary, times binary, most binary, least binary, sizes binary, seen binary"


def _counted(rows: DataFrame, sent, hit_type: str) -> DataFrame:
    """A row for each shard: the lists of all phrases one after the other, and what is needed of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def shard() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            own = table.filter(pc.is_null(table["term"])).combine_chunks()
            own = own.take(pc.sort_indices(own["doc"]))
            place = own["doc"].to_numpy()
            size = int(place[-1]) + 1 if len(place) else 0
            live, sizes, seen = np.zeros(size, bool), np.zeros(size, np.int32), np.zeros(size, bool)
            live[place], sizes[place], seen[place] = True, own["size"].to_numpy(), own["seen"].to_numpy()
            # By number; where one is deleted, its neighbour's stands for it.
            by_number = pa.array(np.maximum(np.cumsum(live) - 1, 0))
            ids, groups = (pa.concat_arrays(own[c].chunks).take(by_number) if size else pa.array([], table.schema.field(c).type) for c in ("hit_id", "grp"))
            lists = Lists(sent.value, np.r_[live, False], np.r_[sizes, 0])
            terms = table.filter(pc.is_valid(table["term"]))
            for batch in terms.to_batches():
                columns = [unpacked(batch.column(c), w) for c, w in zip(_LISTS, widths_of(batch.column("widths")[0].as_py()), strict=True)]
                columns[0][0][:] = np.minimum(columns[0][0], size)
                lists.add(batch.column("term"), columns)
            found = list(lists.phrases())
            joined = lambda n: np.concatenate([f[n] for f in found]) if found else np.empty(0)
            values = [[f[0] for f in found]], [[len(f[1]) for f in found]], *([_flat(joined(n), "<i4")] for n in (1, 2, 3, 4)), [_flat(sizes, "<i4")], [_flat(seen & live, "?")]
            kinds = [pa.list_(pa.int32())] * 2 + [pa.binary()] * 6
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            return pa.RecordBatch.from_arrays([*(pa.array(v, k) for v, k in zip(values, kinds, strict=True)), one(ids), one(groups)], ["phrases", "counts", "docs", "times", "most", "least", "sizes", "seen", "ids", "groups"])

        for batch in batches:
            names = batch.column(0).to_pylist()
            cut = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in zip(cut, cut[1:], strict=False):
                if a == b:
                    continue
                if held and names[a] != now:
                    yield shard()
                    held.clear()
                now = names[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield shard()

    return rows.mapInArrow(run, f"{_COUNTED}, ids array<{hit_type}>, `groups` array<string>")


def best_of(lists: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]], sizes: np.ndarray, allowed: np.ndarray, average: float, k: int, cutoff: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, rounded scores, postings scored): all that may be among the k best.

    lists: documents, how often, maxima of blocks, weight, for each phrase. They are taken by falling bound and added up. The
    k-th best sum so far is a cutoff. A document that no list had yet goes if its block's bound and those of all lists to
    come stay below the cutoff; once these alone stay below, only documents that still can reach it are looked up.
    """
    impact = lambda weight, times, size: weight * times * (K1 + 1) / (times + K1 * (1 - B + B * size / average))
    blocks = [impact(weight, most, least) for *_, most, least, weight in lists]
    bounds = [b.max() for b in blocks]
    order = sorted(range(len(lists)), key=lambda i: -bounds[i])
    rest = np.r_[np.cumsum([bounds[i] for i in order][::-1])[::-1], 0.0]
    total, open_, looked = np.zeros(len(sizes)), allowed.copy(), 0
    few: np.ndarray | None = None
    for n, i in enumerate(order):
        docs, times, _, _, weight = lists[i]
        if few is None and rest[n] < cutoff - _SLACK:
            few = np.flatnonzero((total > 0) & (total + rest[n] >= cutoff - _SLACK))
        if few is not None:
            at = np.searchsorted(docs, few)
            at[at == len(docs)] = 0
            hit = docs[at] == few
            total[few[hit]] += impact(weight, times[at[hit]], sizes[few[hit]])
            looked += int(hit.sum())
            continue
        good = open_[docs]
        low = blocks[i] + rest[n + 1] < cutoff - _SLACK
        if low.any():
            new = np.repeat(low, BLOCK)[: len(docs)] & (total[docs] == 0)
            open_[docs[new]] = False
            good &= ~new
        docs, times = docs[good], times[good]
        total[docs] += impact(weight, times, sizes[docs])
        looked += len(docs)
        if len(total) > k:
            cutoff = max(cutoff, np.partition(total, len(total) - k)[len(total) - k])
    hits = np.flatnonzero(total > 0) if few is None else few
    scores = np.round(total[hits], 6)
    if len(hits) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        hits, scores = hits[scores >= floor], scores[scores >= floor]
    first = np.lexsort((hits, -scores))[:k]
    return hits[first], scores[first], looked


def wanted(asked) -> Column:
    """Whether a term is one that the phrases of a block name, or begins like the last word of one."""
    exact = sorted({part for parts, prefix in asked.phrases for part in (parts[:-1] if prefix else parts)})
    begun: dict[int, set[str]] = defaultdict(set)
    for parts, prefix in asked.phrases:
        if prefix:
            begun[len(parts[-1])].add(parts[-1])
    found = F.col("term").isin(exact)
    for length, starts in begun.items():
        found = found | F.substring("term", 1, length).isin(sorted(starts))
    return found


class InvertedIndex:
    """An index in a folder; see the module's text. `attrs` are columns that a search's filter may use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def segments(self) -> list[int]:
        """The segments that are there as a whole."""
        top = self._path("docs")
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(top)]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("segment=") and fs.exists(self._path(f"docs/{n}/_SUCCESS")))

    def table(self, name: str) -> DataFrame:
        schema = {"postings": "term string, shard long, widths int, " + ", ".join(f"{c} binary" for c in _LISTS) + ", segment int, bucket int", "lexicon": "term string, n_docs long, segment int"}.get(name)
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(f"{self.folder}/{name}").filter(F.col("segment").isin(self.segments()))

    def docs(self) -> DataFrame:
        """Documents that are not deleted."""
        every, top = self.table("docs"), self._path("deleted")
        if not top.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(top):
            return every
        gone = self.spark.read.parquet(f"{self.folder}/deleted").groupBy("hit_id").agg(F.max("before").alias("before"))
        return every.join(gone, (every["hit_id"] == gone["hit_id"]) & (every["segment"] < gone["before"]), "left_anti")

    def extend(self, texts: DataFrame, attrs: tuple[str, ...] = (), spread: int | None = None) -> InvertedIndex:
        """Add a segment of (hit_id, text[, grp] and attributes). Texts are worked on where they are read; `spread` deals them to
        so many tasks first, for a table in fewer pieces than there are cores. A null text is empty; a null hit_id is left out; rows that
        repeat an id are texts of their own; an empty table adds nothing that can be found."""
        if taken := {a.lower() for a in attrs} & {"shard", "doc", "hit_id", "size", "grp", "segment", "bucket", "term", *_LISTS}:
            raise ValueError(f"the index has columns of its own named {sorted(taken)}")
        number = max(self.segments(), default=-1) + 1
        known = texts.filter("hit_id IS NOT NULL")
        rows = materialize(_segment_rows(known.repartition(spread) if spread else known, list(attrs)), "segment")
        postings = rows.filter("term IS NOT NULL").select("bucket", "term", "shard", "widths", *_LISTS)
        # A term that every shard has is spread over tasks by shard.
        spread = postings.repartition("bucket", F.col("shard") % 16).sortWithinPartitions("bucket", "term", "shard")
        own = lambda name: f"{self.folder}/{name}/segment={number}"
        spread.write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(own("postings"))
        lexicon = postings.groupBy("term").agg(F.sum(F.expr("octet_length(docs) div (widths & 15)")).alias("n_docs"))
        lexicon.write.mode("overwrite").parquet(own("lexicon"))
        rows.filter("term IS NULL").select("shard", "doc", "hit_id", "size", "grp", *attrs).write.mode("overwrite").parquet(own("docs"))
        dropped(rows)
        return self

    def remove(self, ids: DataFrame) -> InvertedIndex:
        """Documents of these ids (hit_id) are found no more, until they are added again."""
        ids.select("hit_id", F.lit(max(self.segments(), default=-1) + 1).alias("before")).write.mode("append").parquet(f"{self.folder}/deleted")
        return self

    def statistics(self) -> DataFrame:
        """One row: number of texts and their average length in tokens."""
        return self.docs().agg(F.count("*").alias("n_texts"), F.avg("size").alias("avg_len"))

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """(hit_id, term, tf, doc_len), of all terms or of the given ones (term)."""

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # Rows of equal widths lie together, a shard's or several's.
            for batch in (b.slice(i, j - i) for b in batches for i, j in stretches(b.column(5).to_numpy())):
                wide = widths_of(batch.column(5)[0].as_py())
                (docs, bounds), (times, _) = unpacked(batch.column(3), wide[0]), unpacked(batch.column(4), wide[1])
                row = pa.array(np.repeat(np.arange(len(batch)), np.diff(bounds)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(row) for i in range(3)), pa.array(docs.astype(np.int32)), pa.array(times)], ["segment", "shard", "term", "doc", "tf"])

        rows = self.table("postings")
        if terms is not None:
            rows = rows.join(terms.select("term").distinct().withColumn("bucket", (F.crc32("term") % BUCKETS).cast("int")), ["bucket", "term"])
        each = rows.select("segment", "shard", "term", "docs", "times", "widths").mapInArrow(each, "segment int, shard long, term string, doc int, tf long")
        return each.join(self.docs(), ["segment", "shard", "doc"]).select("hit_id", "term", "tf", F.col("size").alias("doc_len"))

    def _terms(self, sent) -> DataFrame:
        """(term, bucket): the terms of the index that the phrases need."""

        def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = sent.value.phrases
            exact = pa.array({part for parts, prefix in phrases for part in (parts[:-1] if prefix else parts)}, pa.string())
            begun: dict[int, set[str]] = defaultdict(set)
            for parts, prefix in phrases:
                if prefix:
                    begun[len(parts[-1])].add(parts[-1])
            for batch in batches:
                terms = batch.column(0)
                mask = pc.is_in(terms, exact)
                for length, starts in begun.items():
                    mask = pc.or_(mask, pc.is_in(pc.utf8_slice_codeunits(terms, 0, length), pa.array(starts, terms.type)))
                yield pa.RecordBatch.from_arrays([terms.filter(mask)], ["term"])

        met = self.table("lexicon").select("term").mapInArrow(needed, "term string").distinct()
        return met.withColumn("bucket", (F.crc32("term") % BUCKETS).cast("int"))

    def search(self, queries: DataFrame, k: int, where: Column | None = None, same_group: bool = False, block: int = 4096) -> DataFrame:
        """(query_id, hit_id, score, rank), as `keyword_top` over the texts. Queries go in blocks of bounded size; a block
        reads the postings of its terms and the documents' lengths, and sends each shard's to a task."""
        from larkspan.operators.keyword import query_phrases

        phrases = query_phrases(queries)
        asked = materialize(phrases if not same_group else phrases.join(queries.select("query_id", F.col("grp").cast("string").alias("grp")), "query_id"), "asked")
        blocks = max(1, -(-asked.count() // block))
        out = None
        for number in range(blocks):
            own = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number) if blocks > 1 else asked
            found = self._block(own if same_group else own.withColumn("grp", F.lit(None).cast("string")), k, where, same_group)
            out = found if out is None else out.unionByName(found)
        return top_k_per(out, ["query_id"], [F.col("score").desc(), "hit_id"], k)

    def _block(self, own: DataFrame, k: int, where: Column | None, same_group: bool) -> DataFrame:
        from larkspan.operators.keyword import Asked

        if not self.segments():
            raise ValueError(f"there is no index in {self.folder}")
        asked = Asked(own.orderBy("query_id").collect())
        sent = self.spark.sparkContext.broadcast(asked)
        docs, query_type = self.docs(), own.schema["query_id"].dataType.simpleString()
        hit_type = docs.schema["hit_id"].dataType.simpleString()
        seen = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
        shard = F.concat_ws(":", "segment", "shard").alias("shard")
        none = lambda name, kind: F.lit(None).cast(kind).alias(name)
        places = F.col("places") if asked.longer else none("places", "binary")
        terms = materialize(self._terms(sent), "terms")
        # Few terms are sent to every task, which also leaves out buckets; many are looked for by what the block asks, whose
        # size is that of its queries. Neither way moves postings that nobody asked for.
        size = terms.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
        postings = self.table("postings")
        found = postings.join(F.broadcast(terms), ["bucket", "term"]) if size <= SENT else postings.filter(wanted(asked))
        met = found.select(shard, "term", "widths", "docs", "times", places, "most", "least", none("doc", "int"), none("hit_id", hit_type), none("size", "int"), none("grp", "string"), F.lit(False).alias("seen"))
        heads = docs.select(shard, none("term", "string"), none("widths", "int"), *(none(c, "binary") for c in _LISTS), "doc", "hit_id", "size", "grp", seen.alias("seen"))
        n_texts, average, shards = docs.select("size", shard).agg(F.count("*"), F.avg("size"), F.count_distinct("shard")).first()
        # As many tasks as shards, and more where these are few and would meet in one.
        rows = heads.unionByName(met).repartition(max(1, shards, min(4 * shards, 200)), "shard").sortWithinPartitions("shard")
        counted = materialize(_counted(rows, sent, hit_type), "frequencies")
        frequent = counted.select(F.explode(F.arrays_zip("phrases", "counts")).alias("p")).groupBy("p.phrases").agg(F.sum("p.counts").alias("n")).collect()
        told = self.spark.sparkContext.broadcast((n_texts, average or 1.0, {r.phrases: r.n for r in frequent}))

        def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, (n, average, documents) = sent.value, told.value
            frequency = np.array([documents.get(i, 0) for i in range(len(asked.phrases))], float)
            idf = np.maximum(np.log((n - frequency + 0.5) / (frequency + 0.5)), 1e-6)
            cutoffs = np.full(len(asked.ids), -np.inf)
            for batch in batches:
                for i in range(len(batch)):
                    numbers, counts = (batch.column(c)[i].values.to_numpy() for c in ("phrases", "counts"))
                    docs, times, most, least, sizes = (np.frombuffer(batch.column(c)[i].as_py(), "<i4") for c in ("docs", "times", "most", "least", "sizes"))
                    seen, ends, blocks = np.frombuffer(batch.column("seen")[i].as_py(), "?"), np.cumsum(counts), -(-counts // BLOCK)
                    over = np.cumsum(blocks)
                    lists = {p: (docs[b - c : b], times[b - c : b], most[y - x : y], least[y - x : y]) for p, c, b, x, y in zip(*(a.tolist() for a in (numbers, counts, ends, blocks, over)), strict=True)}
                    groups = np.array(batch.column("groups")[i].values.to_pylist(), object) if same_group else None
                    rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                    for query, (wanted, often) in enumerate(asked.wanted):
                        mine = [(*lists[p], idf[p] * o) for p, o in zip(wanted.tolist(), often.tolist(), strict=True) if p in lists]
                        if not mine:
                            continue
                        allowed = seen & (groups == asked.groups[query]) if same_group else seen
                        hits, scores, _ = best_of(mine, sizes, allowed, average, k, cutoffs[query])
                        if len(hits) >= k:
                            cutoffs[query] = max(cutoffs[query], scores[-1])
                        rows.append((np.full(len(hits), query), hits, scores))
                    if rows:
                        query, hits, scores = (np.concatenate(x) for x in zip(*rows, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array([asked.ids[q] for q in query.tolist()]), batch.column("ids")[i].values.take(pa.array(hits.astype(np.int64))), pa.array(scores)], ["query_id", "hit_id", "score"])

        return counted.mapInArrow(rank, f"query_id {query_type}, hit_id {hit_type}, score double")


def build_index(texts: DataFrame, folder: str, attrs: tuple[str, ...] = (), spread: int | None = None) -> InvertedIndex:
    """A new index of (hit_id, text[, grp] and attributes) in a folder that has none."""
    return InvertedIndex(texts.sparkSession, folder).extend(texts, attrs, spread)
