"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

A sequence of tokens is the BPE encoding of its bytes exactly if each token is the encoding of its own bytes and each
neighbouring pair stays as it is when its bytes are encoded together. So the encodings are the paths of a finite-state
machine whose states are (last token, bytes begun since). It is nondeterministic, as bytes may begin several tokens; its
determinisation keeps the set of states that are possible. Of the tokens that may end at a byte only one can be the last
of an encoding, as what has been read has one encoding; a deterministic state names it. Once a single state is possible,
all tokens before what it has begun are settled and are emitted, read backwards from there. Transitions are computed when
first taken and kept.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import table, text_or_empty
from larkspan.llm.parts import LETTERS, Parts, batches, joined, per_text, woven


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class Transducer:
    """Encodes single pieces of text; `most_states` bounds the states that are kept."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = 120_000):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"no token for the bytes {missing[:5]}")
        #: The trie of all tokens: child of node * 256 + byte, the token that ends at a node, whether one goes on.
        self.child: dict[int, int] = {}
        self.ends_token: list[int] = [-1]
        self.depth = [0]
        self.goes_on = bytearray(1)
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self.goes_on[node] = 1
                key = node << 8 | byte
                node = self.child.get(key, 0)
                if not node:
                    node = self.child[key] = len(self.ends_token)
                    self.ends_token.append(-1)
                    self.depth.append(self.depth[key >> 8] + 1)
                    self.goes_on.append(0)
            self.ends_token[node] = rank
        self.size = {rank: len(token) for token, rank in ranks.items()}
        self._ends = [-2] * len(self.ends_token)
        self.most_states = most_states
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        start = ((-1, 0),)
        self.states = [start]
        self.number = {start: 0}
        #: The token that ends where the state is reached, -1 for none.
        self.done = [-1]
        #: From state * 256 + byte: 256 * the next state.
        self.moves: dict[int, int] = {}

    def merged(self, data: bytes, below: float = float("inf")) -> list[bytes]:
        """What the merges of a rank under `below` make of the bytes: the lowest rank first, the leftmost of equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte, and for a token that no merges lead to."""
        if token not in self._parts:
            data = self.token[token]
            halves = self.merged(data, token) if len(data) > 1 else []
            self._parts[token] = (self.ranks[halves[0]], self.ranks[halves[1]]) if len(halves) == 2 else None
        return self._parts[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether the pair stays as it is: going back in time, no merge across the boundary comes before those beside it."""
        ranks, token, parts = self.ranks, self.token, self._parts
        a, b, limit, good = left, right, float("inf"), True
        while True:
            if ranks.get(token[a] + token[b], limit) < limit:
                good = False
                break
            inner = parts[a] if a in parts else self.parts(a)
            outer = parts[b] if b in parts else self.parts(b)
            if inner is None and outer is None:
                break
            if outer is None or (inner is not None and a > b):
                limit, a = a, inner[1]
            else:
                limit, b = b + 1, outer[0]
        if len(self._fits) > 300_000:
            self._fits.clear()
        self._fits[left << 32 | right] = good
        return good

    def _token_at(self, node: int) -> int:
        """The token that ends at a node, found once: -1 for none, or for one that no merges lead to."""
        token = self.ends_token[node]
        if token >= 0 and len(self.token[token]) > 1 and self.parts(token) is None:
            token = -1
        self._ends[node] = token
        return token

    def _move(self, key: int) -> int:
        byte, after = key & 255, []
        child, ends, fits, goes_on = self.child.get, self._ends, self._fits.get, self.goes_on
        done = -1
        for last, node in self.states[key >> 8]:
            to = child(node << 8 | byte)
            if to is None:
                continue
            if goes_on[to]:
                after.append((last, to))
            if done >= 0:
                continue
            token = ends[to]
            if token == -2:
                token = self._token_at(to)
            if token >= 0:
                good = last < 0 or fits(last << 32 | token)
                if good is None:
                    good = self.fits(last, token)
                if good:
                    done = token
        if done >= 0:
            after.append((done, 0))
        rest = tuple(after)
        target = self.number.get(rest)
        if target is None:
            target = self.number[rest] = len(self.states)
            self.states.append(rest)
            self.done.append(done)
        move = self.moves[key] = target << 8
        return move

    def _back(self, path: list[int], end: int) -> list[int]:
        """The tokens of the first `end` bytes of a path."""
        done, size, out = self.done, self.size, []
        while end:
            token = done[path[end - 1] >> 8]
            out.append(token)
            end -= size[token]
        out.reverse()
        return out

    def encode(self, piece: bytes) -> list[int]:
        token = self.ranks.get(piece)
        if token is not None:
            return [token]  # as the library does, also for a token that no merges lead to
        if len(self.states) > self.most_states:
            self._reset()
        known, state, path, out = self.moves.get, 0, [], []
        for byte in piece:
            key = state | byte
            state = known(key)
            if state is None:
                state = self._move(key)
            path.append(state)
            if len(path) > 256 and len(self.states[state >> 8]) == 1:
                settled = len(path) - self.depth[self.states[state >> 8][0][1]]
                out += self._back(path, settled)
                del path[:settled]
        return out + self._back(path, len(path))


#: The pattern under which a single space begins a piece and a single line feed is one; a fixed value.
BLANKS_BEGIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Two white-space characters that meet, by Unicode's White_Space property, or a NUL; fixed values.
_SPACE = r"[\x{09}-\x{0D} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_IRREGULAR = rf"{_SPACE}{_SPACE}|\x{{00}}"
#: A long text may be cut before these, as a piece begins there.
_CUT = re.compile(r"(?<=[A-Za-z0-9.,;]) (?=[A-Za-z0-9])")


class Encoder:
    """Encodes texts; the ids of at most `most` parts of units and two thirds as many states are
    remembered.

    Under `BLANKS_BEGIN` a text is cut before each space and around each line feed, and units are looked up by their word
    and the punctuation behind it. Texts where white-space characters meet, and all texts under another pattern, are cut
    by the pattern itself.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = 400_000):
        # The library's \s is Unicode's White_Space property.
        self.split = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
        self.regular = pattern == BLANKS_BEGIN
        self.transducer = Transducer(ranks, 2 * most // 3)
        self.parts = Parts("<i4", self._encoded, most)

    @staticmethod
    def _simple(words: pa.Array) -> pa.Array:
        return pc.match_substring_regex(words, rf"^ ?[{LETTERS}]+$")

    @staticmethod
    def _never(words: pa.Array) -> pa.Array:
        return pa.array(np.zeros(len(words), bool))

    def _encoded(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encode = self.transducer.encode
        if not self.regular:
            return joined([encode(u.encode()) for u in units], "<i4")
        plain = self._simple(pa.array(units, pa.string())).to_pylist()
        rows = [encode(u.encode()) if p else list(chain.from_iterable(encode(x.encode()) for x in self.split.findall(u))) for u, p in zip(units, plain, strict=True)]
        return joined(rows, "<i4")

    def _pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        found = [self.split.findall(t) for t in texts.to_pylist()]
        return pa.array(list(chain.from_iterable(found)), texts.type), np.r_[0, np.cumsum([len(f) for f in found])]

    def encode(self, text: str) -> list[int]:
        return self.encode_all(pa.array([text], pa.string()))[0].tolist()

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids of each)."""
        odd = pc.match_substring_regex(texts, _IRREGULAR).to_numpy(zero_copy_only=False) if self.regular else np.ones(len(texts), bool)
        if odd.all():
            flat, bounds = self._pieces(texts)
            ids, sizes = self.parts.gather(flat, self._never, None)
            return ids, per_text(sizes, bounds)
        if odd.any():
            return woven(odd, *(self.encode_all(texts.filter(pa.array(m))) for m in (odd, ~odd)))
        split = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0"), "\0")
        ids, sizes = self.parts.gather(split.flatten(), self._simple, None)
        return ids, per_text(sizes, np.r_[0, np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False))])


#: UTF-8's lead bytes, fixed values of the encoding: (first, last, continuation bytes, range of the first of these).
_LEADS = [(0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F)]
_LEAD = {byte: (count, low, high) for first, last, count, low, high in _LEADS for byte in range(first, last + 1)}


class Decoder:
    """Decodes ids as they come; characters whose bytes are spread over tokens appear when their last byte does."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.whole: dict[int, str] = {}
        for number, token in tokens.items():
            try:
                self.whole[number] = token.decode("utf-8")
            except UnicodeDecodeError:
                pass
        self.open = b""
        self.need, self.low, self.high = 0, 0, 0

    def _feed(self, data: bytes) -> str:
        out = []
        for byte in data:
            if self.need:
                if self.low <= byte <= self.high:
                    self.open += bytes([byte])
                    self.need, self.low, self.high = self.need - 1, 0x80, 0xBF
                    if not self.need:
                        out.append(self.open.decode())
                    continue
                out.append("�")
                self.need = 0
            if byte < 0x80:
                out.append(chr(byte))
            elif byte in _LEAD:
                self.open = bytes([byte])
                self.need, self.low, self.high = _LEAD[byte]
            else:
                out.append("�")
        return "".join(out)

    def decode(self, ids: list[int]) -> Iterator[str]:
        """Texts that follow one another, for ids in any number of calls."""
        whole, tokens = self.whole, self.tokens
        for start in range(0, len(ids), 256):
            part = ids[start : start + 256]
            if not self.need:
                try:  # tokens of whole characters leave the machine where it is
                    yield "".join(map(whole.__getitem__, part))
                    continue
                except KeyError:
                    pass
            for number in part:
                text = whole.get(number) if not self.need else None
                yield text if text is not None else self._feed(tokens[number])

    def end(self) -> str:
        """What is left at the end of a stream: a mark for a character cut off."""
        cut, self.need = bool(self.need), 0
        return "�" if cut else ""


_CODERS: dict[tuple[str, str, int], tuple[Encoder, dict[int, bytes]]] = {}


def coders(data: bytes, pattern: str, most: int = 400_000) -> tuple[Encoder, dict[int, bytes]]:
    """One encoder a worker process, whatever the number of tasks."""
    key = (hashlib.sha256(data).hexdigest(), pattern, most)
    if key not in _CODERS:
        ranks = parse_ranks(data)
        _CODERS[key] = (Encoder(ranks, pattern, most), {rank: token for token, rank in ranks.items()})
    return _CODERS[key]


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, remembered: int = 400_000) -> DataFrame:
    """One row per row of `docs`: id, n_tokens, ids_sha256, decoded_sha256 and, with `with_ids`, ids (array of int).

    The rank file is read on the driver; its size bounds what is broadcast. `remembered` bounds the memory of a worker
    process: parts of units whose ids it keeps, a few hundred bytes each. Defined results: null counts as empty, empty
    texts have no tokens; strings of special tokens are ordinary text; rows are independent of one another, so repeated
    rows get equal results; other columns, whatever their names, are not read; an empty table gives an empty result; very
    long texts are encoded in stretches.
    """
    data = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tokens = coders(data.value, pattern, remembered)
        name = {number: str(number) for number in tokens}
        decoder = Decoder(tokens)
        for batch in rows:
            done = 0
            begun: list[np.ndarray] = []  # ids of the text that the slices before have begun
            for texts, whole in batches(batch.column(1), _CUT):
                ids, sizes = encoder.encode_all(texts)
                if not whole:
                    begun.append(ids)
                    continue
                if begun:
                    ids = np.concatenate([*begun, ids])
                    sizes, begun = np.array([len(ids)]), []
                ends = np.cumsum(sizes)
                shas, decoded = [], []
                for last, size in zip(ends.tolist(), sizes.tolist(), strict=True):
                    sha, back = hashlib.sha256(), hashlib.sha256()
                    for at in range(last - size, last, 1 << 16):
                        part = ids[at : min(last, at + (1 << 16))].tolist()
                        sha.update((" " * (at > last - size) + " ".join(map(name.__getitem__, part))).encode())
                        back.update("".join(decoder.decode(part)).encode())
                    back.update(decoder.end().encode())
                    shas.append(sha.hexdigest())
                    decoded.append(back.hexdigest())
                columns = [batch.column(0).slice(done, len(sizes)), pa.array(sizes, pa.int64()), pa.array(shas), pa.array(decoded)]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids)))
                    names.append("ids")
                done += len(sizes)
                yield pa.RecordBatch.from_arrays(columns, names)
            pa.default_memory_pool().release_unused()

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    source = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
