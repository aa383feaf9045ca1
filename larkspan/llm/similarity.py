"""Near copies: texts whose sets of word shingles have a Jaccard similarity of at least 4/5, as components.

SimHash fingerprints that link name the first candidates, whole sets decide, and an exact join finds the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm import simhash
from larkspan.llm.common import discard, materialize
from larkspan.llm.components import components
from larkspan.llm.simhash import SEED, majority, shingle_hashes

#: The least similarity, as a fraction.
PART, WHOLE = 4, 5
#: Shingles are told apart by this many bytes of their hashes.
WIDTH = 6
#: Rounds in which nodes are compared with leaders.
ROUNDS = 2
#: Members of a group that a task compares with the group's leader at most; a larger group is dealt to several tasks.
MEMBERS = 256
#: Bits of the map that tells which texts have a shingle in common with another.
SLOT_BITS = 22
#: Texts counted for the order of shingles, and shingles put last at most; neither changes the result.
SAMPLE, LAST = 4096, 1 << 16


def distinct_of(parts: list[np.ndarray]) -> np.ndarray:
    """The distinct hashes, ascending."""
    return np.unique(np.concatenate(parts) & np.uint64((1 << 8 * WIDTH) - 1)) if parts else np.empty(0, np.uint64)


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """The distinct hashes of the text's shingles, ascending."""
    return distinct_of(list(shingle_hashes(text or b"", n)))


def packed(shingles: np.ndarray) -> bytes:
    return shingles.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // WIDTH, 8), np.uint8)
    out[:, :WIDTH] = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    return out.view("<u8").ravel()


def node_of(shingles: np.ndarray) -> int:
    """A signed 64-bit digest; equal sets are one node."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes(), SEED)).astype(np.int64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return WHOLE * common >= PART * (len(a) + len(b) - common)


def sketch(shingles: np.ndarray) -> bytes:
    """A bit for each slot of a power of two of them, two to four times as many as shingles: whether an odd number falls in."""
    slots = 1 << max(6, len(shingles).bit_length() + 1)
    odd = np.bincount((shingles & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """A lower bound of how many shingles only one of two sets has: a slot whose bits differ holds at least one.

    The longer sketch is folded: slots that the shorter one doesn't tell apart are added up, and so their parities."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def prefix(shingles: np.ndarray, common: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The first shingles by weight and hash, of which two sets that are similar share at least one.

    Similar sets share at least 4/5 of either, so at most n - ceil(4n/5) of n are missing from the other, and the smallest
    shared one is among one more than these. This holds for any order; one that has frequent shingles last has fewer meet.
    """
    n = len(shingles)
    if not n:
        return shingles
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        known = np.where(common[at] == shingles, weight[at], 0)
        if known.any():
            shingles = shingles[np.argsort(known, kind="stable")]
    return shingles[: n + 1 - -(-PART * n // WHOLE)]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).view(np.int64)))


def frequent(source: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a bounded sample have, ascending, and in how many of them they are."""
    rate = max(1, source.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py(), n).view(np.int64))], ["h"])

    counts = source.filter(F.pmod("slot", F.lit(rate)) == 0).select("text").mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n"))
    rows = counts.filter("n > 1").orderBy(F.col("n").desc(), "h").limit(LAST).collect()
    common, weight = np.array([r[0] for r in rows], np.int64).view(np.uint64), np.array([r[1] for r in rows], np.int64)
    order = np.argsort(common)
    return common[order], weight[order]


def marked(source: DataFrame, n: int, common: np.ndarray, weight: np.ndarray) -> DataFrame:
    """(doc, node, size, slot, fp, sketch, keys) of (doc, text, slot): the set's digest, size, sketch and prefix, and the
    text's fingerprint."""
    sent = source.sparkSession.sparkContext.broadcast((common, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, weight = sent.value
        for batch in batches:
            nodes, sizes, fps, sketches, keys, first, held = [], [], [], [], [], 0, 0
            for i, text in enumerate(batch.column(1).cast(pa.binary()), 1):
                parts = list(shingle_hashes(text.as_py() or b"", n))
                found = distinct_of(parts)
                fps.append(majority(parts))
                nodes.append(node_of(found))
                sizes.append(len(found))
                sketches.append(sketch(found))
                keys.append(prefix(found, common, weight))
                held += len(keys[-1])
                if held > 500_000 or i == batch.num_rows:
                    part = batch.slice(first, i - first)
                    columns = [part.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), part.column(2), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sketches, pa.binary()), _lists(keys)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc", "node", "size", "slot", "fp", "sketch", "keys"])
                    nodes, sizes, fps, sketches, keys, first, held = [], [], [], [], [], i, 0

    return source.select("doc", "text", "slot").mapInArrow(run, "doc long, node long, size int, slot int, fp long, sketch binary, keys array<long>")


def shingle_sets(source: DataFrame, n: int, slots: np.ndarray) -> DataFrame:
    """(node, shingles) of the texts whose slot is among those given; a set may come more than once."""
    bits = np.zeros(1 << SLOT_BITS, bool)
    bits[slots] = True
    sent = source.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(sent.value).astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(wanted[batch.column(1).to_numpy()]))
            nodes, held, size = [], [], 0
            for i, text in enumerate(batch.column(0).cast(pa.binary()), 1):
                found = shingle_set(text.as_py(), n)
                nodes.append(node_of(found))
                held.append(packed(found))
                size += len(found)
                if size > 500_000 or i == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(held, pa.binary())], ["node", "shingles"])
                    nodes, held, size = [], [], 0

    return source.select("text", "slot").mapInArrow(run, "node long, shingles binary")


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, size, node) sorted by these those whose key another node has too that may be similar by its size. One
    row is held from batch to batch, whatever the number that share a key."""
    held, paired = None, False
    for batch in batches:
        now = [c.to_numpy() for c in batch.columns]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        key, size, node = now
        if not len(key):
            continue
        new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
        key, size, node = (x[new] for x in (key, size, node))
        # By size, the next row on either side is the closest one.
        near = (key[1:] == key[:-1]) & (PART * size[1:].astype(np.int64) <= WHOLE * size[:-1].astype(np.int64))
        same = np.r_[paired, near]
        out = np.flatnonzero(same[:-1] | same[1:])
        if len(out):
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (key, size, node)], ["key", "size", "node"])
        held, paired = [x[-1:] for x in (key, size, node)], bool(same[-1])
    if held is not None and paired:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["key", "size", "node"])


def _pairs(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    u, v = np.minimum(u, v), np.maximum(u, v)
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    new = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])]
    return pa.RecordBatch.from_arrays([pa.array(u[new]), pa.array(v[new])], ["u", "v"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v) of nodes that share a key, may be similar by their sizes and sketches and are not in one component yet;
    rows (key, size, node, label, sketch) are sorted by key. Sketches are compared here, and pairs that can't be similar
    are never made into rows."""

    def bucket(size: np.ndarray, node: np.ndarray, label: np.ndarray, sketches: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        _, of, counts = np.unique(label, return_inverse=True, return_counts=True)
        data = [np.frombuffer(x, np.uint8) for x in sketches.to_pylist()]
        lengths = np.array([len(x) for x in data])
        for length in np.unique(lengths):
            # Sizes of similar sets are so close that one sketch is at most twice as long as the other.
            here = np.flatnonzero((lengths == length) | (lengths == 2 * length))
            folded = np.stack([data[i] if lengths[i] == length else data[i][:length] ^ data[i][length:] for i in here])
            # Each pair across components has a node outside of the largest; of two sketches of one length it comes once.
            for at in np.flatnonzero((of[here] != counts.argmax()) | (lengths[here] == 2 * length)):
                i = here[at]
                if of[i] == counts.argmax() and not (lengths[here] == length).any():
                    continue
                other = lengths[here] == length if lengths[i] == 2 * length else np.ones(len(here), bool)
                fits = other & (label[here] != label[i]) & (PART * np.maximum(size[here], size[i]) <= WHOLE * np.minimum(size[here], size[i]))
                near = np.flatnonzero(fits)
                if len(near):
                    off = np.bitwise_count(folded[near] ^ folded[at]).sum(axis=1, dtype=np.int64)
                    near = near[(WHOLE + PART) * off <= (WHOLE - PART) * (size[here[near]].astype(np.int64) + size[i])]
                if len(near):
                    yield np.full(len(near), node[i]), node[here[near]]

    held, u, v, count = None, [], [], 0

    def settle(now: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        nonlocal u, v, count
        key, size, node, label = (c.to_numpy() for c in now.columns[:4])
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(key)], strict=True):
            for x, y in bucket(size[a:b], node[a:b], label[a:b], now.column(4).slice(a, b - a)):
                u.append(x)
                v.append(y)
                count += len(x)
                if count > 500_000:
                    yield _pairs(np.concatenate(u), np.concatenate(v))
                    u, v, count = [], [], 0

    for batch in batches:
        now = batch if held is None else pa.concat_batches([held, batch])
        if not len(now):
            continue
        key = now.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1]))
        held = now.slice(last)
        if last:
            yield from settle(now.slice(0, last))
    if held is not None and len(held):
        yield from settle(held)
    if count:
        yield _pairs(np.concatenate(u), np.concatenate(v))


def promising(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v, off): the pairs (u, v) that may be similar by their sketches, and the differing part of both sets at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = np.array([differing(a.as_py(), b.as_py()) for a, b in zip(batch.column(3), batch.column(5), strict=True)], np.int64)
            both = batch.column(2).to_numpy().astype(np.int64) + batch.column(4).to_numpy()
            keep = (WHOLE + PART) * of <= (WHOLE - PART) * both
            columns = [batch.column(0), batch.column(1), pa.array(of / np.maximum(both, 1))]
            yield pa.RecordBatch.from_arrays(columns, ["u", "v", "off"]).filter(pa.array(keep))

    for end, size, own in (("u", "su", "ku"), ("v", "sv", "kv")):
        pairs = pairs.join(nodes.select(F.col("node").alias(end), F.col("size").alias(size), F.col("sketch").alias(own)), end)
    return pairs.select("u", "v", "su", "ku", "sv", "kv").mapInArrow(run, "u long, v long, off double")


def confirmed(pairs: DataFrame, nodes: DataFrame, source: DataFrame, n: int) -> DataFrame:
    """Those of the pairs (u, v) whose sets are similar; only texts that are in a pair are made into sets.

    Pairs are grouped by v, the leader: its set meets the others' in one sorted stream, in which it alone is held. A large
    group is dealt to several tasks, each with the leader's set.
    """
    pairs = materialize(pairs, "pairs")
    deals = pairs.groupBy("v").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("deals"))
    dealt = pairs.join(deals, "v").select("u", "v", F.pmod(F.xxhash64("u"), F.col("deals")).cast("int").alias("deal"))
    members = dealt.select(F.col("u").alias("node"), "v", "deal", F.lit(True).alias("member"))
    wanted = materialize(members.unionAll(dealt.select(F.col("v").alias("node"), "v", "deal", F.lit(False)).distinct()), "wanted")
    slots = wanted.select("node").distinct().join(nodes, "node").select("slot").distinct().toPandas()["slot"].to_numpy(np.int64)
    sets = shingle_sets(source, n, slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, None
        for batch in batches:
            u, v = [], []
            for node, to, deal, member, data in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4), strict=True):
                found = unpacked(data.as_py())
                if not member:
                    leader, own = (to, deal), found
                elif leader == (to, deal) and similar(own, found):
                    u.append(node)
                    v.append(to)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    met = wanted.join(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "node").select("node", "v", "deal", "member", "shingles")
    met = met.repartition("v", "deal").sortWithinPartitions("v", "deal", "member", "node")
    out = materialize(met.mapInArrow(run, "u long, v long"), "similar")
    discard(pairs, wanted)
    return out


def fingerprinted(marks: DataFrame, max_bits: int, most: int) -> DataFrame:
    """(u, v) for each node u whose fingerprint hangs together, by links of at most `max_bits` bits, with that of others: v
    is their leader, the one with the most texts."""
    texts = materialize(marks.groupBy("node", "fp").agg(F.count("*").alias("n")), "fingerprints")
    root = components(simhash.linked(texts.select("fp").distinct(), max_bits, most)).withColumnRenamed("u", "fp")
    rows = texts.join(root, "fp", "left").select("node", "n", F.coalesce("v", "fp").alias("root"))
    leaders = rows.groupBy("root").agg(F.max(F.struct("n", "node")).alias("leader"), F.count("*").alias("of")).filter("of > 1")
    pairs = rows.join(leaders, "root").select(F.col("node").alias("u"), F.col("leader.node").alias("v"))
    out = materialize(pairs.filter("u <> v").distinct(), "near")
    discard(texts)
    return out


def labelled(met: DataFrame, label: DataFrame | None) -> DataFrame:
    """(key, size, node, label): label tells the component, a node without links is its own."""
    if label is None:
        return met.withColumn("label", F.col("node"))
    return met.join(label, "node", "left").select("key", "size", "node", F.coalesce("label", "node").alias("label"))


def led(met: DataFrame, label: DataFrame | None, nodes: DataFrame, number: int) -> DataFrame:
    """(u, v) for each node u that may be similar to one of its keys' leaders v outside its component: the closest by sketch.

    The leader of a key's nodes of about one size is, in the first round, the one whose keys the most nodes share, for
    copies with few changes have most in common with the others; in later rounds one by a hash.
    """
    rows = labelled(met, label).withColumn("level", F.floor(F.log("size") / F.log(F.lit(WHOLE / PART))).cast("int"))
    if number:
        rows = rows.withColumn("rank", F.xxhash64("node", F.lit(number)))
    else:
        shared = met.groupBy("key").agg(F.count("*").alias("n"))
        rows = rows.join(met.join(shared, "key").groupBy("node").agg(F.sum("n").alias("rank")), "node")
    best = F.max(F.struct("rank", "node", "label")).alias("leader")
    leaders = rows.groupBy("key", "level").agg(best).select("key", "level", F.col("leader.node").alias("v"), F.col("leader.label").alias("of_v"))
    pairs = rows.join(leaders, ["key", "level"]).filter("label <> of_v").select(F.col("node").alias("u"), "v").distinct()
    return promising(pairs, nodes).groupBy("u").agg(F.min_by("v", F.struct("off", "v")).alias("v"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, max_bits: int = 4, most: int = 1024) -> DataFrame:
    """One row per row of `docs`: id and component_id, the smallest id reachable by pairs with a similarity of 4/5 or more.

    First come those whose SimHash fingerprints link: each is compared with the leader of its fingerprints' component.
    Fingerprints miss many such pairs; prefixes bring together every one, and the whole sets decide. In a few rounds each node is compared with one of
    the leaders of its keys, the closest by sketch. All other pairs are compared only if they are across the components
    found by then, so a large group of copies is not paired off. Texts without words are equal to one another; a component without any id that isn't null has a null component_id.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("doc"), text.alias("text"), F.pmod(F.xxhash64(text), F.lit(1 << SLOT_BITS)).cast("int").alias("slot"))
    marks = materialize(marked(source, shingle, *frequent(source, shingle)), "prefixes")
    # Texts of one set may have several slots; any of them finds the set again.
    nodes = marks.groupBy("node").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.min("slot").alias("slot"))
    keyed = marks.select(F.explode("keys").alias("key"), "size", "node").repartition("key").sortWithinPartitions("key", "size", "node")
    met = materialize(keyed.mapInArrow(_meet, "key long, size int, node long"), "met")
    near = fingerprinted(marks, max_bits, most)
    edges, label, done = None, None, [met, near]
    for number in range(-1, ROUNDS):
        pairs = led(met, label, nodes, number) if number >= 0 else promising(near, nodes).select("u", "v")
        found = confirmed(pairs, nodes, source, shingle)
        if found.isEmpty():
            if number < 0:
                continue
            break
        edges = found if edges is None else edges.unionAll(found)
        label = materialize(components(edges).select(F.col("u").alias("node"), F.col("v").alias("label")), "labels")
        done += [found, label]
    named = materialize(labelled(met, label), "labelled")
    mixed = named.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("key")
    apart = named.join(mixed, "key", "left_semi").join(nodes.select("node", "sketch"), "node").select("key", "size", "node", "label", "sketch")
    rest = apart.repartition("key").sortWithinPartitions("key").mapInArrow(_across, "u long, v long").distinct()
    more = confirmed(rest, nodes, source, shingle)
    whole = components(more if edges is None else edges.unionAll(more))
    discard(*done, named, more)
    distinct = marks.groupBy("node").agg(F.min("doc").alias("first"))
    rooted = distinct.join(whole.select(F.col("u").alias("node"), "v"), "node", "left").select("node", "first", F.coalesce("v", "node").alias("root"))
    low = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    out = marks.select("doc", "node").join(rooted.join(low, "root").select("node", "component_id"), "node")
    return out.select(F.col("doc").alias(id_col), "component_id")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` whose id is that of their component, with all their columns: one document of each group.

    Rows that share an id are one document. Where a component has no id but null, its rows stay.
    """
    groups = similar_groups(docs.select(id_col, text_col), id_col, text_col, **options)
    stay = groups.filter(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("_stay")).distinct()
    return docs.join(stay, docs[id_col].eqNullSafe(stay["_stay"]), "left_semi")
