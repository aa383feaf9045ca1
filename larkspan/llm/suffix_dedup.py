"""Removal of long repeated strings by buckets of windows that are refined where they may still split.

A suffix array up to the order that matters here would sort every position of the corpus by its first `length` bytes, as
bucket-pointer refinement does round by round. Here identifiers of buckets are content hashes instead of ranks, so that
the identifier of a later offset needs no lookup and no round that computes it, and only buckets that may still split go
on to the next level.

Level 1. Each window of `length` bytes belongs to its anchor, the position in it whose q-gram has the smallest hash.
Equal windows have equal anchors at equal offsets, so one row stands for all windows of an anchor within a step of
offsets. Rows are bucketed by the bytes that all these windows share (the core).
Level 2. A bucket of two or more rows is sorted by the bytes that its windows cover together (the hull). Rows with equal
hulls repeat each other in every window and are settled; a row alone in its core's bucket is settled too: it repeats
nothing. Rows that share the core but not the hull, at the ends of what repeats, go on.
Level 3. Only their windows get rows of their own, whose identifier is made of those of its quarters; windows that meet there
repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import materialize, table, text_or_empty

SEGMENT = 1 << 18
GATHER = 8 << 20
_POS = np.uint64((1 << 20) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Hashes of any substring of a segment in constant time, from prefix sums of byte codes times powers of a base."""

    def __init__(self, seed: int, size: int):
        rng = np.random.default_rng(seed)
        self.codes = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(1, 1 << 61)) * 8 + 5
        self.powers = np.full(size, base, np.uint64)
        self.inverse = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        self.powers[0] = self.inverse[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(self.powers, out=self.powers)
            np.multiply.accumulate(self.inverse, out=self.inverse)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.codes[data] * self.powers[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start, end) -> np.ndarray:
        return _mix((sums[end] - sums[start]) * self.inverse[start])


_HASHERS: dict[int, tuple[Hasher, Hasher]] = {}


def hashers(length: int) -> tuple[Hasher, Hasher]:
    if length not in _HASHERS:
        size = SEGMENT + 2 * length + 1
        _HASHERS[length] = (Hasher(11, size), Hasher(23, size))
    return _HASHERS[length]


def segments(text: bytes, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, bytes) of pieces that together hold each window of the text once."""
    data = np.frombuffer(text, np.uint8)
    for start in range(0, len(data) - length + 1, SEGMENT):
        yield start, data[start : start + SEGMENT + length - 1]


def anchors(gram_hash: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` hashes the place of the smallest, the leftmost of equals."""
    keyed = (gram_hash & ~_POS) | np.arange(len(gram_hash), dtype=np.uint64)
    count = len(keyed) - width + 1
    padded = np.full(-(-len(keyed) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keyed)] = keyed
    rows = padded.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(after[:count], before[width - 1 : width - 1 + count])
    return (low & _POS).astype(np.int64)


def window_rows(text: bytes, length: int, gram: int, step: int) -> tuple[np.ndarray, ...] | None:
    """Level 1 for a text: (core, hull, first, last), first and last window of each row."""
    first_hasher, second_hasher = hashers(length)
    out = []
    for offset, data in segments(text, length):
        one, two = first_hasher.sums(data), second_hasher.sums(data)
        at = np.arange(len(data) - gram + 1)
        anchor = anchors(first_hasher.of(one, at, at + gram), length - gram + 1)
        window = np.arange(len(anchor))
        bucket = (anchor - window) // step
        cut = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (bucket[1:] != bucket[:-1])])
        first, last = cut, np.r_[cut[1:], len(anchor)] - 1
        anchor, bucket = anchor[cut], bucket[cut]
        core = first_hasher.of(one, anchor - bucket * step, anchor - (bucket * step + step - 1) + length)
        core = _mix(core + bucket.astype(np.uint64))
        shape = ((anchor - first) * 2 * length + (anchor - last)).astype(np.uint64)
        hull = _mix(second_hasher.of(two, first, last + length) + shape)
        out.append((core, hull, first + offset, last + offset))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else None


COLUMNS = ["k1", "k2", "doc", "mark", "first", "last", "state"]
SCHEMA = "k1 long, k2 long, doc long, mark long, first int, last int, state int"
#: What the state of a row says. LONE and KNOWN are inputs of `settle`, the others its results.
LONE, KNOWN, REPEATED, OPEN, PARTNER = 0, 1, 2, 3, 4


def _batch(k1, k2, doc, mark, first, last, state) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(k1).view(np.int64)), pa.array(np.asarray(k2).view(np.int64)), pa.array(np.asarray(doc)), pa.array(np.asarray(mark)), pa.array(np.asarray(first).astype(np.int32)), pa.array(np.asarray(last).astype(np.int32)), pa.array(np.asarray(state).astype(np.int32))], COLUMNS)


def fold(k1, k2, doc, mark, first, last, wanted) -> Iterator[pa.RecordBatch]:
    """Combine before the shuffle: rows that repeat each other here are settled here, and one KNOWN row stands for them.

    So a string in a third of all documents reaches the next task a few times for each task, not once a document. Settled
    rows travel under a key made from the document, which spreads them.
    """
    order = np.lexsort((k2, k1))
    k1, k2, doc, mark, first, last, wanted = (x[order] for x in (k1, k2, doc, mark, first, last, wanted))
    same = (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1])
    twice = np.r_[False, same] | np.r_[same, False]
    head = np.r_[True, ~same]
    yield _batch(*(x[head] for x in (k1, k2, doc, mark, first, last)), np.where(twice[head], KNOWN, np.where(wanted[head], LONE, PARTNER)))
    done = twice & wanted
    if done.any():
        spread = _mix(mark[done].view(np.uint64))
        yield _batch(spread, spread, *(x[done] for x in (doc, mark, first, last)), np.full(int(done.sum()), REPEATED))


def settle(refine: bool):
    """A function over rows sorted by k1, k2: REPEATED for rows that share both keys with another.

    With refine, a row that shares k1 alone becomes OPEN, and one row of each settled k2 beside it PARTNER. Rows stream:
    of a run of equal keys, however long, one row is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the columns of the first row of the run that is still open
        held_several = held_sent = held_after = False
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            through = cols[6] == REPEATED
            if through.any():
                yield _batch(*(x[through] for x in cols))
                cols = [x[~through] for x in cols]
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.r_[h, c] for h, c in zip(held, cols, strict=True)]
            k1, k2, state = cols[0], cols[1], cols[6]
            sent = np.isin(state, (KNOWN, PARTNER))
            head = np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]
            start = np.flatnonzero(head)
            size = np.diff(np.r_[start, len(k1)])
            several = (size > 1) | (np.maximum.reduceat((state == KNOWN).astype(int), start) > 0)
            joined = np.r_[False, k1[start[1:]] == k1[start[:-1]]]
            if held is not None:
                several[0] |= held_several
                sent[0] |= held_sent
                joined[0] |= held_after
            near = joined | np.r_[joined[1:], False]
            several_row = np.repeat(several, size)
            now = several_row & ~sent
            if now.any():
                yield _batch(*(x[now] for x in cols[:6]), np.full(int(now.sum()), REPEATED))
            closed = np.arange(len(start)) < len(start) - 1
            if refine:
                yield from opened(cols, start, several, near, closed)
            at = start[-1]
            held = [x[at : at + 1] for x in cols]
            held_several, held_sent, held_after = bool(several[-1]), bool(sent[at] or several[-1]), bool(joined[-1])
        if held is not None and refine and held_after:
            yield _batch(*held[:6], [PARTNER if held_several else OPEN])

    def opened(cols, start, several, near, closed) -> Iterator[pa.RecordBatch]:
        for which, state in ((~several & near & closed, OPEN), (several & near & closed, PARTNER)):
            if which.any():
                at = start[which]
                yield _batch(*(x[at] for x in cols[:6]), np.full(len(at), state))

    return run


def _sorted_by_key(rows: DataFrame) -> DataFrame:
    return rows.repartition("k1").sortWithinPartitions("k1", "k2")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, mark, body): doc and mark tell rows apart, whatever ids repeat or are null."""
    text = text_or_empty(text_col)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("doc"), F.xxhash64(F.col(id_col).cast("long"), text).alias("mark"), text.alias("body"))


def repeated_windows(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc, mark, first, last): windows, as ranges of their starts, whose string also starts elsewhere."""
    step = max(1, length // 4)

    def level_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for doc, mark, text in zip(batch.column(0).to_numpy(), batch.column(1).to_numpy(), texts, strict=True):
                text = text.as_py()
                if len(text) < length:
                    continue
                core, hull, first, last = window_rows(text, length, gram, step)
                rows.append((core, hull, np.full(len(core), doc), np.full(len(core), mark), first, last))
                size += len(text)
                if size > GATHER:
                    cols = [np.concatenate(x) for x in zip(*rows, strict=True)]
                    yield from fold(*cols, np.ones(len(cols[0]), bool))
                    rows, size = [], 0
        if rows:
            cols = [np.concatenate(x) for x in zip(*rows, strict=True)]
            yield from fold(*cols, np.ones(len(cols[0]), bool))

    quarter = length // 4
    tail = length - 3 * quarter

    def level_three(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = hashers(length)
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for doc, mark, text, spans in zip(batch.column(0).to_numpy(), batch.column(1).to_numpy(), texts, batch.column(3).to_pylist(), strict=True):
                text = text.as_py()
                keys: dict[int, list] = {}
                for offset, data in segments(text, length):
                    sums = [h.sums(data) for h in pair]
                    for span in spans:
                        lo, hi = max(span["first"], offset), min(span["last"], offset + len(data) - length)
                        if lo > hi:
                            continue
                        at = np.arange(lo - offset, hi - offset + 1)
                        full = []
                        for h, s in zip(pair, sums, strict=True):
                            b0, b1, b2 = (h.of(s, at + i * quarter, at + (i + 1) * quarter) for i in range(3))
                            b3 = h.of(s, at + 3 * quarter, at + 3 * quarter + tail)
                            half, later = _mix(b0 * np.uint64(3) + b1), _mix(b2 * np.uint64(3) + b3)
                            full.append(_mix(half * np.uint64(3) + later))
                        keys.setdefault(span["state"], []).append((*full, at + offset))
                for state, found in keys.items():
                    k1, k2, at = (np.concatenate(x) for x in zip(*found, strict=True))
                    rows.append((k1, k2, np.full(len(at), doc), np.full(len(at), mark), at, at, np.full(len(at), state == OPEN)))
                    size += len(at)
                if size > 400_000:
                    yield from fold(*(np.concatenate(x) for x in zip(*rows, strict=True)))
                    rows, size = [], 0
        if rows:
            yield from fold(*(np.concatenate(x) for x in zip(*rows, strict=True)))

    marked = materialize(_sorted_by_key(keyed.mapInArrow(level_one, SCHEMA)).mapInArrow(settle(True), SCHEMA).select(*COLUMNS[2:]), "windows")
    settled = marked.filter(F.col("state") == REPEATED).select("doc", "mark", "first", "last")
    going_on = marked.filter(F.col("state") != REPEATED)
    if going_on.isEmpty():
        return settled
    spans = going_on.groupBy("doc", "mark").agg(F.collect_list(F.struct("first", "last", "state")).alias("spans"))
    probed = keyed.join(spans, ["doc", "mark"]).select("doc", "mark", "body", "spans")
    ends = _sorted_by_key(probed.mapInArrow(level_three, SCHEMA)).mapInArrow(settle(False), SCHEMA)
    return settled.unionAll(materialize(ends.select("doc", "mark", "first", "last"), "ends"))


def covered(spans: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the windows cover."""
    runs: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if runs and first <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], last + length))
        else:
            runs.append((first, last + length))
    return runs


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = 64) -> DataFrame:
    """One row per row of `docs`: id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes).

    A byte goes if a string of `length` bytes over it also starts anywhere else, in this text or another. Defined
    results: null counts as empty; a text shorter than `length` stays whole; rows that repeat id and text repeat each
    other; what remains may end within a UTF-8 character, so it is binary; columns other than the two named are not read.
    """
    if not 1 <= gram <= length // 4:
        raise ValueError("gram is at least 1 and at most a quarter of length")
    keyed = _keyed(docs, id_col, text_col)
    spans = repeated_windows(keyed, length, gram).groupBy("doc", "mark").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    real = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col).cast("long"), text_or_empty(text_col)).alias("mark"), F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("doc"), text_or_empty(text_col).alias("body"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, found in zip(batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                text, kept, at = text.as_py(), [], 0
                runs = covered([(s["first"], s["last"]) for s in found.as_py() or ()], length)
                for start, end in runs:
                    kept.append(text[at:start])
                    at = end
                rest = b"".join([*kept, text[at:]])
                for column, value in zip(out, (len(text), len(text) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    rows = real.join(spans, ["doc", "mark"], "left").select("id", "body", "spans")
    return rows.mapInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").withColumnRenamed("id", id_col)


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
