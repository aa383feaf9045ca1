"""Detection of periodic runs of words by Karp-Miller-Rosenberg naming.

Blocks of 2^k words of a text get names, equal for equal blocks: a pair of names of one level makes a name of the next.
Only blocks that occur again in their text keep a name; all others can match nothing. The longest common extension of two
places goes down the levels and takes each block that has the same name at both.

A run of period q holds places g and g + q from which q words or more agree. Places on a grid of 2^k words are enough
for periods from 2^k to 2^(k+1): among the places where a block of that size occurs again, those at such a distance
are candidates, found by their place in the order of (name, place). Candidates are extended both ways; what reaches the
length is a run, and of equal stretches the one with the smallest period counts. A text costs n log n, however it
repeats itself, as a grid place has at most 2^k candidates. Texts are worked on many at a time, in one row of words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import WORD_PATTERN, fresh, table, text_or_empty

_WORD = re.compile(WORD_PATTERN)
#: Words that are worked on at once, and candidates; a longer text is worked on alone.
WORDS, CANDIDATES = 200_000, 1 << 20
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Names:
    """Names of the blocks of 2^k words at every place, for each level k; -1 for blocks that don't occur again."""

    def __init__(self, keys: np.ndarray):
        """keys: one for each word, equal for equal words of one text."""
        self.size = len(keys)
        self.levels: list[np.ndarray] = []
        #: For each level the places that have names, in the order of (name, place), and their names.
        self.order: list[tuple[np.ndarray, np.ndarray]] = []
        places = np.arange(self.size)
        while len(places) and self._add(keys, places):
            k, level = len(self.levels) - 1, self.levels[-1]
            places = np.flatnonzero((level[: max(0, self.size - (1 << k))] >= 0) & (level[1 << k : self.size] >= 0))
            keys = level[places].astype(np.int64) * self.size + level[places + (1 << k)]

    def _add(self, keys: np.ndarray, places: np.ndarray) -> bool:
        order = np.argsort(keys, kind="stable")
        sorted_keys = keys[order]
        same = sorted_keys[1:] == sorted_keys[:-1]
        again = np.r_[same, False] | np.r_[False, same]
        if not again.any():
            return False
        names = np.cumsum(~np.r_[False, same][again]) - 1
        where = places[order[again]]
        level = np.full(self.size + 1, -1, np.int32)
        level[where] = names
        self.levels.append(level)
        self.order.append((where, names))
        return True

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on, i < j."""
        i, j, begun = i.copy(), j.copy(), i
        for k in reversed(range(len(self.levels))):
            level = self.levels[k]
            name = level[i]
            step = ((name >= 0) & (name == level[j])).astype(np.int64) << k
            i += step
            j += step
        return i - begun

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i equal those before j, i < j."""
        i, j, begun = i.copy(), j.copy(), i
        for k in reversed(range(len(self.levels))):
            level = self.levels[k]
            # The last place of a level has no name; it stands for all that lies before the first word.
            name = level[np.maximum(i - (1 << k), -1)]
            step = ((name >= 0) & (name == level[np.maximum(j - (1 << k), -1)])).astype(np.int64) << k
            i -= step
            j -= step
        return begun - i

    def candidates(self, k: int, near: int, far: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place on the grid of 2^k words, distance from `near` to `far` at which its block occurs again), in lots."""
        where, names = self.order[k]
        stride = 2 * self.size + far + 2
        keys = names * stride + where
        grid = where & ((1 << k) - 1) == 0
        places, base = where[grid], keys[grid]
        left, right = np.searchsorted(keys, base + near), np.searchsorted(keys, base + far, "right")
        some = right > left
        places, left, count = places[some], left[some], (right - left)[some]
        ends = np.cumsum(count)
        first = 0
        while first < len(places):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + CANDIDATES, "right")))
            own = count[first:last]
            at = np.repeat(left[first:last] - (ends[first:last] - own - before), own) + np.arange(int(own.sum()))
            begun = np.repeat(places[first:last], own)
            yield begun, where[at] - begun
            first = last


def find_runs(keys: np.ndarray, least: int = 24, times: int = 3) -> np.ndarray:
    """Rows (start, end, smallest period) of the maximal runs of at least max(least, times * period) words, in order.

    keys: one for each word, equal for equal words of one text; times is at least 3. The lowest level of blocks that
    takes part is such that shorter periods, whose runs have `least` words, reach over a grid place too.
    """
    if times < 3:
        raise ValueError("a run has its period three times or more")
    # A run of period q has max(least, times * q) - q agreeing places; blocks and grid of 2^k need 2^(k+1) - 1 of them.
    lowest = 0
    while min(max(least, times * q) - q for q in range(1, 1 << lowest + 2)) >= (1 << lowest + 2) - 1:
        lowest += 1
    names = Names(keys)
    found = []
    for k in range(lowest, len(names.levels)):
        for at, period in names.candidates(k, 1 if k == lowest else 1 << k, (2 << k) - 1):
            start = at - names.backward(at, at + period)
            end = at + period + names.forward(at, at + period)
            good = end - start >= np.maximum(least, times * period)
            if good.any():
                found.append(np.unique(np.stack([start[good], end[good], period[good]], axis=1), axis=0))
    if not found:
        return np.empty((0, 3), np.int64)
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]]


def kept_words(size: int, runs: np.ndarray) -> np.ndarray:
    """Marks of the words that no run holds after its first period."""
    depth = np.zeros(size + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 1], -1)
    return np.cumsum(depth)[:size] == 0


def _worked(texts: list[list[str]], least: int, times: int) -> Iterator[tuple[list[dict], str]]:
    """(runs, what remains) of each text, given by its words."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    coded = pa.array([w for t in texts for w in t], pa.large_string()).dictionary_encode()
    keys = np.repeat(np.arange(len(texts)), sizes) * (len(coded.dictionary) + 1) + coded.indices.to_numpy().astype(np.int64)
    rows = find_runs(keys, least, times)
    bounds = np.r_[0, np.cumsum(sizes)]
    cut = np.searchsorted(rows[:, 0], bounds)
    for number, words in enumerate(texts):
        own = rows[cut[number] : cut[number + 1]]
        if not len(own):
            yield [], " ".join(words)
            continue
        own = own - [bounds[number], bounds[number], 0]
        keep = kept_words(len(words), own)
        own = own[np.lexsort((own[:, 2], own[:, 0]))]
        yield [{"start": s, "length": e - s, "period": q} for s, e, q in own.tolist()], " ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])


def collapse_runs(docs: DataFrame, text_col: str = "text", least: int = 24, times: int = 3, runs_col: str = "runs", collapsed_col: str = "collapsed") -> DataFrame:
    """`docs` with its runs, [(start, length, period)] by start, then period, counted in words, and the collapsed text.

    A run is a stretch of words with a smallest period of at least max(least, times * period) words that no neighbour
    extends. The collapsed text has the words, joined by one space, that no run holds after its first period. One scan and no
    shuffle; a task holds the words of about WORDS words of texts, or of one longer text, and some 4 * log2(n) bytes a
    word of text that repeats itself.

    Defined results: null counts as empty, with no runs and an empty collapsed text; repeated rows are worked on each for
    itself; columns that docs has already under the new names are replaced; an empty table gives no rows.
    """
    others = [c for c in docs.columns if c.lower() not in (runs_col.lower(), collapsed_col.lower())]
    text, one, two = fresh(docs, "body", runs_col + "_new", collapsed_col + "_new")
    source = docs.select(*(F.col(f"`{c}`") for c in others), text_or_empty(text_col).alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, held, size, first = batch.num_columns - 1, [], 0, 0
            for place, value in enumerate(batch.column(last), 1):
                held.append(_WORD.findall(value.as_py()))
                size += len(held[-1])
                if size >= WORDS or place == len(batch):
                    found, left = zip(*_worked(held, least, times), strict=True)
                    kept = batch.slice(first, place - first)
                    yield pa.RecordBatch.from_arrays([*kept.columns[:last], pa.array(found, pa.list_(pa.struct({"start": pa.int64(), "length": pa.int64(), "period": pa.int64()}))), pa.array(left, pa.string())], [*kept.schema.names[:last], one, two])
                    held, size, first = [], 0, place

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]), f"`{one}` {RUNS}", f"`{two}` string"])
    return source.mapInArrow(run, schema).withColumnsRenamed({one: runs_col, two: collapsed_col})


def plant_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): the texts of a tenth of the ids made periodic, as the contract of the query says.

    With h = crc32(id) and g = h div 10: where h % 10 is 0, words from a = g % n on repeat those of the first
    p = 1 + (n - a) div (3 + g % 8) of them. A null id or a text without words stays as it is.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.crc32(F.col(id_col).cast("string")).alias("h"))
    source = source.withColumn("words", F.when(F.col("h") % 10 == 0, F.expr(r"regexp_extract_all(text, r'[^\x20\x09-\x0D]+', 0)")))
    source = source.withColumn("n", F.size("words")).withColumn("g", F.expr("h div 10"))
    source = source.withColumn("a", F.expr("IF(n > 0, CAST(g % n AS INT), 0)"))
    source = source.withColumn("p", F.expr("CAST(1 + (n - a) div (3 + g % 8) AS INT)"))
    planted = F.expr("array_join(concat(slice(words, 1, a), slice(flatten(array_repeat(slice(words, a + 1, p), CAST(ceil((n - a) / p) AS INT))), 1, n - a)), ' ')")
    return source.select(F.col("id").alias(id_col), F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias(text_col))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """The run with the greatest length/period is found by products of whole numbers; the first of equals stays."""
    rows = collapse_runs(plant_periods(table(spark, sf_dir, "documents")), collapsed_col="text")
    more = "r.length * b.period > b.length * r.period"
    best = F.expr(f"aggregate(runs, CAST(NULL AS struct<start:bigint,length:bigint,period:bigint>), (b, r) -> IF(b IS NULL OR {more}, r, b))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
