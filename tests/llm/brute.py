"""Plain single-machine versions that the operators are held against."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def simhash(text, n=4):
    words = WORD.findall(lower(text))
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_groups(docs, n=4, bits=4):
    """docs: (id, text) -> {(id, hex, component)}"""
    fps = [(i, simhash(t, n)) for i, t in docs]
    distinct = sorted({f for _, f in fps})
    parent = {f: f for f in distinct}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(distinct):
        for b in distinct[k + 1 :]:
            if (a ^ b).bit_count() <= bits:
                parent[root(a)] = root(b)
    low = {}
    for i, f in fps:
        r = root(f)
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return sorted(((i, f"{f:016x}", low.get(root(f))) for i, f in fps), key=repr)


def remove_repeats(docs, length):
    """docs: (id, text) -> [(id, n_bytes, n_removed, n_spans, sha)]"""
    texts = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(b[p : p + length] for _, b in texts for p in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)
