"""Token ids of many texts at once, by way of the distinct parts of their units.

Texts are cut into units and units are numbered in Arrow's compiled code; only parts that no earlier batch had are encoded
one by one. The ids of a batch are then gathered from those of its parts by array operations.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters that neither normalisation nor the version of Unicode changes: Latin, Greek and Cyrillic ones in fixed ranges,
#: without the two (U+0130, U+03A3) whose lower case is more than a letter or depends on its place.
LETTERS = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{2AF}\x{388}-\x{38A}\x{38C}\x{38E}-\x{3A1}\x{3A4}-\x{3CE}\x{400}-\x{481}\x{48A}-\x{52F}"
#: Punctuation that both tokenizers cut from the word before it, as one piece.
CLOSING = ".,!?;:"
BATCH = 2 << 20


class Parts:
    """Remembers the ids of parts, which `encode` gives as all ids in order and the number of each; `most` bounds their number and, eightfold, that of their ids. Beyond that, those stay
    that several batches had; how many is halved each time, so that none stays for good."""

    def __init__(self, kind: str, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int):
        self.kind, self.encode_all, self.most = np.dtype(kind), encode, most
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.flat = np.empty(1 << 16, self.kind)
        self.start, self.size, self.uses = np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        self.used = 0

    def _shrink(self) -> None:
        names = list(self.number)
        stay = np.flatnonzero(self.uses[: len(names)] > 1)
        if not len(stay) or 4 * len(stay) > 3 * self.most:
            return self._clear()
        size = self.size[stay].astype(np.int64)
        ends = np.cumsum(size)
        flat = self.flat[np.repeat(self.start[stay] - (ends - size), size) + np.arange(ends[-1])]
        self.number = {names[i]: place for place, i in enumerate(stay.tolist())}
        self.flat, self.start, self.size, self.uses, self.used = flat, ends - size, self.size[stay], self.uses[stay] >> 1, len(flat)

    @staticmethod
    def _room(array: np.ndarray, size: int) -> np.ndarray:
        if size <= len(array):
            return array
        grown = np.empty(max(size, 2 * len(array)), array.dtype)
        grown[: len(array)] = array
        return grown

    def numbers(self, parts: list[str]) -> np.ndarray:
        """The number of each part, by which `start` and `size` say where its ids are in `flat`."""
        number = self.number
        out = [number.get(p, -1) for p in parts]
        missing = [i for i, n in enumerate(out) if n < 0]
        if missing:
            ids, sizes = self.encode_all([parts[i] for i in missing])
            first, total = len(number), len(ids)
            self.flat = self._room(self.flat, self.used + total)
            self.start, self.size, self.uses = (self._room(x, first + len(sizes)) for x in (self.start, self.size, self.uses))
            self.flat[self.used : self.used + total] = ids
            self.start[first : first + len(sizes)] = self.used + np.cumsum(sizes) - sizes
            self.size[first : first + len(sizes)] = sizes
            self.used += total
            self.uses[first : first + len(sizes)] = 0
            for place, i in enumerate(missing, first):
                number[parts[i]] = out[i] = place
        found = np.array(out, np.int64)
        self.uses[found] += 1
        return found

    def gather(self, units: pa.Array, simple: Callable[[pa.Array], pa.Array], fold: Callable[[pa.Array], pa.Array] | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units in order, number of ids of each). A unit whose word, without the punctuation behind it, is
        `simple` is looked up as that word, folded, and the punctuation; any other as a whole."""
        if len(self.number) > self.most or self.used > 8 * self.most:
            self._shrink()
        coded = units.dictionary_encode()
        own = coded.dictionary
        word = pc.utf8_rtrim(own, CLOSING)
        plain = simple(word)
        head = pc.if_else(plain, fold(word) if fold else word, own)
        behind = pa.array(np.full(len(own), ""), own.type)
        cut = pc.and_(plain, pc.greater(pc.binary_length(own), pc.binary_length(word)))
        if pc.any(cut).as_py():
            # What is cut off has only ASCII characters, so lengths in bytes are lengths in characters.
            lengths = pc.subtract(pc.binary_length(own), pc.binary_length(word)).to_numpy()
            ends = pc.filter(own, cut).to_pylist()
            tails = [e[-n:] for e, n in zip(ends, lengths[cut.to_numpy(zero_copy_only=False)].tolist(), strict=True)]
            behind = pc.replace_with_mask(behind, cut, pa.array(tails, own.type))
        numbers = []
        for column in (head, behind):
            distinct = column.dictionary_encode()
            numbers.append(self.numbers(distinct.dictionary.to_pylist())[distinct.indices.to_numpy()])
        of = np.stack(numbers, axis=1)
        at = coded.indices.to_numpy()
        sizes = self.size[of].sum(axis=1)[at].astype(np.int64)
        sequence = of[at].ravel()
        size = self.size[sequence].astype(np.int64)
        sequence, size = sequence[size > 0], size[size > 0]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        place = np.repeat(self.start[sequence] - (ends - size), size) + np.arange(total)
        return self.flat[place], sizes


def joined(rows: list[list[int]], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids as (all ids in order, the number of each)."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter(chain.from_iterable(rows), kind, int(sizes.sum())), sizes


def woven(which: np.ndarray, one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and numbers of rows that came in two lots: `one` for the rows that `which` marks, `other` for the rest."""
    sizes = np.empty(len(which), np.int64)
    sizes[which], sizes[~which] = one[1], other[1]
    ids = np.empty(int(sizes.sum()), one[0].dtype)
    mask = np.repeat(which, sizes)
    ids[mask], ids[~mask] = one[0], other[0]
    return ids, sizes


def per_text(sizes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of `sizes` over the stretches that `offsets` bound."""
    sums = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def batches(texts: pa.Array, cut: re.Pattern, size: int = BATCH) -> Iterator[tuple[pa.Array, bool]]:
    """Slices of about `size` bytes of text, and whether the last text of the slice ends in it.

    A text of over four times that size comes in pieces, each a slice of its own, cut before matches of `cut`.
    """
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    bound = np.cumsum(lengths)
    first = 0
    while first < len(texts):
        if lengths[first] > 4 * size:
            text, at = texts[first].as_py(), 0
            while found := cut.search(text, at + size):
                yield pa.array([text[at : found.start()]], texts.type), False
                at = found.start()
            yield pa.array([text[at:]], texts.type), True
            first += 1
            continue
        before = bound[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(bound, before + size, "right")))
        yield texts.slice(first, last - first), True
        first = last
