"""SimHash near-dedup: fingerprints, pigeonring filtering, connected components."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import materialize, table
from larkspan.llm.components import components, forest

BITS = 64
SEED = 42
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The text in pieces of about `size` bytes, cut at white space, so that a huge text is never held as words at once."""
    start = 0
    while start < len(text):
        cut = _SPACE.search(text, start + size) if start + size < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[start:end]
        start = end


def shingle_hashes(text: bytes, n: int) -> Iterator[np.ndarray]:
    """Arrays of the XXH64 of each n-word shingle, repeats included; the whole sequence where there are fewer words."""
    held: list[bytes] = []
    any_yet = False
    for piece in _pieces(text.lower()):  # bytes.lower() changes A-Z alone, bytes.split() cuts at the six ASCII spaces
        held += piece.split()
        if len(held) >= n:
            ends = list(accumulate(len(w) + 1 for w in held))
            starts = [0, *ends[: len(held) - n]]
            joined = b" ".join(held)
            yield np.array([xxhash.xxh64_intdigest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[n - 1 :], strict=True)], np.uint64)
            any_yet = True
            held = held[len(held) - n + 1 :] if n > 1 else []
    if held and not any_yet:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], np.uint64)


def majority(parts: Iterable[np.ndarray]) -> int:
    """Bit j is 1 if set in over half of the hashes; none give 0."""
    ones, total = np.zeros(BITS, np.int64), 0
    for hashes in parts:
        for i in range(0, len(hashes), 8192):
            part = hashes[i : i + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, n: int) -> int:
    return majority(shingle_hashes(text or b"", n))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(doc, fp): fp is the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py(), n) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc long, fp long")


class Ring:
    """Segments of the fingerprint on a ring, and the patterns by which candidates meet.

    With `max_bits` + 1 segments and at most `max_bits` differing bits, some segment starts a chain around the ring whose
    first l segments differ in at most l * max_bits / (max_bits + 1) bits, for every l: none in the first, at most one in
    the first two, at most two in the first three, and so on. Hence two fingerprints that link agree, for that start, in
    the first segment and, when the next two are cut in halves, in both halves of the second or in one half of the second
    and one of the third. Each such pattern is a mask; equal masked bits are the key under which candidates meet.
    """

    def __init__(self, max_bits: int):
        if max_bits % 2 or not 0 <= max_bits <= 16:
            raise ValueError("max_bits is an even number from 0 to 16")
        count = self.count = max_bits + 1
        self.max_bits = max_bits
        bounds = [i * BITS // count for i in range(count + 1)]
        span = lambda lo, hi: ((1 << (hi - lo)) - 1) << lo
        segments = [span(a, b) for a, b in zip(bounds, bounds[1:], strict=False)]
        halves = [(span(a, (a + b) // 2), span((a + b) // 2, b)) for a, b in zip(bounds, bounds[1:], strict=False)]
        self.start: list[int] = []
        masks: list[int] = []
        for i in range(count if max_bits else 0):
            second, third = halves[(i + 1) % count], halves[(i + 2) % count]
            for pair in [second, *((a, b) for a in second for b in third)]:
                masks.append(segments[i] | pair[0] | pair[1])
                self.start.append(i)
        self.masks = masks
        #: chains[l][pattern]: the first l + 2 segments from the pattern's start; the budget is l + 1 bits.
        self.chains = [np.array([sum(segments[(i + k) % count] for k in range(length)) for i in self.start], np.uint64) for length in range(2, count + 1)]

    def within(self, diff: np.ndarray, pattern: np.ndarray) -> np.ndarray:
        """Whether every prefix of the chain keeps its budget; the last prefix is the full Hamming distance."""
        fits = np.ones(diff.shape, bool)
        for budget, chain in enumerate(self.chains, 1):
            fits &= np.bitwise_count(diff & chain[pattern]) <= budget
        return fits


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_links(ring: Ring, most: int):
    """A function over rows (pattern, bits, fp) sorted by pattern and bits: rows (hot, u, v).

    hot 0: u and v are linked, as stars of the components found in a batch. hot 1: u sits in a bucket of over `most`
    fingerprints, which is left to `hub_links`; at most `most` rows of a bucket are held.
    """

    def links(pattern: np.ndarray, run: np.ndarray, fp: np.ndarray, size: np.ndarray):
        u, v = [], []
        small = size <= 32
        p, r, f = pattern[small], run[small], fp[small]
        for d in range(1, 32):
            if len(f) <= d or not (same := np.flatnonzero(r[:-d] == r[d:])).size:
                break
            good = same[ring.within(f[same] ^ f[same + d], p[same])]
            u.append(f[good])
            v.append(f[good + d])
        for k in np.unique(run[~small]):
            at = np.flatnonzero(run == k)
            f = fp[at]
            for i in range(0, len(f), 128):
                diff = f[i : i + 128, None] ^ f[None, :]
                x, y = np.nonzero(ring.within(diff, np.full(diff.shape, pattern[at[0]])))
                u.append(f[i + x])
                v.append(f[y])
        if not u:
            return None
        u, v = np.concatenate(u), np.concatenate(v)
        return forest(u, v) if len(u) else None

    def rows(hot: int, u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), hot, np.int32)), pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["hot", "u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.uint64)]
        flooded = None  # the key of a bucket that proved too large
        for batch in batches:
            now = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
            if flooded is not None and len(now[0]):
                more = (now[0] == flooded[0]) & (now[1] == flooded[1])
                if more.any():
                    yield rows(1, now[2][more], now[2][more])
                    now = [x[~more] for x in now]
            pattern, bits, fp = (np.concatenate(x) for x in zip(held, now, strict=True))
            if not len(fp):
                continue
            start = np.flatnonzero(np.r_[True, (pattern[1:] != pattern[:-1]) | (bits[1:] != bits[:-1])])
            last = start[-1]
            held = [pattern[last:], bits[last:], fp[last:]]
            if len(held[0]) > most:
                flooded = (pattern[last], bits[last])
                yield rows(1, fp[last:], fp[last:])
                held = [x[:0] for x in held]
            yield from settle(pattern[:last], fp[:last], start)
        if len(held[0]):
            yield from settle(held[0], held[2], np.array([0, len(held[0])]))

    def settle(pattern: np.ndarray, fp: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        lengths = np.diff(start[: np.searchsorted(start, len(fp)) + 1]) if len(fp) else np.empty(0, np.int64)
        if not len(lengths):
            return
        size, run_id = np.repeat(lengths, lengths), np.repeat(np.arange(len(lengths)), lengths)
        if (over := size > most).any():
            yield rows(1, fp[over], fp[over])
        several = (size > 1) & ~over
        if several.any() and (found := links(pattern[several], run_id[several], fp[several], size[several])) is not None and len(found[0]):
            yield rows(0, *found)

    return run


def hub_links(hot: DataFrame, max_bits: int) -> DataFrame:
    """(u, v): what connects the fingerprints of `hot` (fp) that differ in at most `max_bits` bits, in linear space.

    Two values differ in at most 2r bits exactly if some value differs from each in at most r. Each fingerprint is sent
    to all values within r bits; those that meet there are linked, with no pair compared and whatever their number.
    """
    radius = max_bits // 2
    flips = np.array([sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(BITS), r)], np.uint64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(fp), 16):
                part = fp[i : i + 16]
                hub = (part[:, None] ^ flips[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(hub.view(np.int64)), pa.array(np.repeat(part, len(flips)).view(np.int64))], ["hub", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub_before, first_before = None, None
        u: list[np.ndarray] = []
        v: list[np.ndarray] = []
        held = 0
        for batch in batches:
            hub, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(hub):
                continue
            start = np.flatnonzero(np.r_[True, hub[1:] != hub[:-1]])
            first = np.repeat(fp[start], np.diff(np.r_[start, len(hub)]))
            if hub_before == hub[0]:
                first[hub == hub[0]] = first_before
            hub_before, first_before = hub[-1], first[-1]
            other = first != fp
            u.append(fp[other])
            v.append(first[other])
            held += int(other.sum())
            if held > 200_000:
                a, b = forest(np.concatenate(u), np.concatenate(v))
                u, v, held = [a], [b], 0
                if len(a) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])
                    u, v = [], []
        if u and sum(map(len, u)):
            a, b = forest(np.concatenate(u), np.concatenate(v))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])

    met = hot.mapInArrow(spread, "hub long, fp long").repartition("hub").sortWithinPartitions("hub")
    return met.mapInArrow(meet, "u long, v long")


def linked(distinct: DataFrame, max_bits: int, most: int) -> DataFrame:
    """Edges (u, v) that connect all of `distinct` (fp) that differ in at most `max_bits` bits."""
    ring = Ring(max_bits)
    if not ring.masks:
        return distinct.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    keys = [F.struct(F.lit(i).alias("pattern"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for i, m in enumerate(ring.masks)]
    keyed = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.pattern", "k.bits", "fp")
    keyed = keyed.repartition("pattern", "bits").sortWithinPartitions("pattern", "bits")
    found = materialize(keyed.mapInArrow(bucket_links(ring, most), "hot int, u long, v long"), "links")
    edges = found.filter("hot = 0").select("u", "v")
    hot = found.filter("hot = 1").select(F.col("u").alias("fp")).distinct()
    return edges if hot.isEmpty() else edges.unionAll(hub_links(hot, max_bits))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4, most: int = 1024) -> DataFrame:
    """One row per row of `docs`: id, fingerprint (16 hex digits), component_id (the smallest id reachable by links).

    Equal fingerprints meet before anything else, so copies are never compared. Defined results: null, empty and blank
    texts have the fingerprint zero; a component without any id that isn't null has a null component_id; repeated rows
    get equal results; columns other than the two named are not read; an empty table gives an empty result.
    """
    marks = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = materialize(marks.groupBy("fp").agg(F.min("doc").alias("first")), "distinct-fingerprints")
    label = components(linked(distinct.select("fp"), max_bits, most))
    rooted = distinct.join(label.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "first", F.coalesce("v", "fp").alias("root"))
    low = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(low, "root").select("fp", "component_id")
    out = marks.join(named, "fp")
    return out.select(F.col("doc").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` whose id is that of their component, with all their columns: one document of each group.

    Rows that share an id are one document. Where a component has no id but null, its rows stay.
    """
    groups = simhash_groups(docs.select(id_col, text_col), id_col, text_col, **options)
    stay = groups.filter(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("_stay")).distinct()
    return docs.join(stay, docs[id_col].eqNullSafe(stay["_stay"]), "left_semi")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
