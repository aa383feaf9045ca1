"""Chunking of texts: sequential by nature, so an Arrow-batched function of one text."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN, MAX, OVERLAP = 80, 1200, 120
#: A text may be cut behind these: the end of a sentence before a space, and the end of a line; fixed values.
_BREAK = re.compile(r"[.?!](?= )|\n")


def windows(block: str, most: int, overlap: int) -> Iterator[str]:
    """Stretches of a long block, cut at its break points.

    A stretch ends at the last break point whose mark is in its room, if that is in the room's second half, else where the
    room ends. The next begins `overlap` characters before that end, but never before half of what was passed.
    """
    breaks = [m.start() for m in _BREAK.finditer(block)]
    # A sentence's mark takes the space behind it too.
    reach = [at + 1 + (block[at] != "\n") for at in breaks]
    start, size = 0, len(block)
    while start < size:
        room = start + most
        if room >= size:
            end = after = size
        else:
            last = bisect_right(reach, room) - 1
            end = breaks[last] + 1 if last >= 0 and 2 * (breaks[last] - start) > most else room
            after = max(end - overlap, start + max(1, (end - start) // 2))
        if piece := block[start:end].strip():
            yield piece
        start = after


def chunk(text: str | None, least: int = MIN, most: int = MAX, overlap: int = OVERLAP) -> list[str]:
    """Paragraphs packed into chunks of at most `most` characters; chunks under `least` go, unless nothing else is there."""
    whole = re.sub(r"[ \t]+\n", "\n", (text or "").replace("\r\n", "\n")).strip()
    blocks = [b for b in map(str.strip, re.split(r"\n{2,}", whole)) if b]
    pieces = [p for b in blocks for p in (windows(b, most, overlap) if len(b) > most else (b,))]
    packed: list[str] = []
    open_ = False
    for piece in pieces:
        if open_ and len(packed[-1]) + len(piece) + 2 <= most:
            packed[-1] += "\n\n" + piece
        else:
            packed.append(piece)
        open_ = len(packed[-1]) < most
    kept = [c for c in map(str.strip, packed) if len(c) >= least]
    return kept or ([whole[:most]] if whole else [])


def chunks(c: Column, least: int = MIN, most: int = MAX, overlap: int = OVERLAP) -> Column:
    """array<string>, in order."""
    return F.udf(lambda t: chunk(t, least, most, overlap), "array<string>", useArrow=True)(c)
