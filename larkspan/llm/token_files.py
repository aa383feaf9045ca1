"""Token ids as flat files: unsigned integer ids, 64-bit offsets, and partition bases from prefix sums."""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm.common import new_path, table, text_or_empty
from larkspan.llm.parts import LETTERS, Parts, batches, joined, per_text, woven

#: Stands for a null id in the file of document ids.
NO_ID = -(1 << 63)
SUFFIXES = ("bin", "off", "doc")


#: A text may be cut before these.
_BLANK = re.compile("[ \n]")


class Units:
    """Ids of whole texts. The tokenizer collapses white space and no token crosses it, so a text's ids are those of its
    blank-separated units in order. It lower-cases and cuts a word from the punctuation behind it, so both are looked up
    apart; a lower-case word goes to its model alone, all else, special tokens' strings too, through all of its steps.
    `most` parts are remembered.
    """

    def __init__(self, data: str, kind: str, most: int = 700_000):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_str(data)
        self.words_only = Tokenizer(self.tokenizer.model)
        self.words_only.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary, suffix = self.tokenizer.get_vocab(), json.loads(data)["model"]["end_of_word_suffix"]
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.kind = kind
        self.parts = Parts(kind, self._encoded, most)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words in lines of a few, which cost less than one by one; the last token of a word ends words, and no other does."""
        lines = [" ".join(words[i : i + 16]) for i in range(0, len(words), 16)]
        found = self.words_only.encode_batch_fast(lines, add_special_tokens=False)
        ids = joined([e.ids for e in found], "<i8")[0]
        ends = np.flatnonzero(self.ends_word[ids])
        if len(ends) != len(words):
            raise ValueError("the vocabulary's words can't be told apart")
        return ids.astype(self.kind), np.diff(np.r_[-1, ends])

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = self._simple(pa.array(texts, pa.string())).to_numpy(zero_copy_only=False)
        plain &= np.fromiter(map(str.islower, texts), bool, len(texts))
        words, rest = [t for t, p in zip(texts, plain.tolist(), strict=True) if p], [t for t, p in zip(texts, plain.tolist(), strict=True) if not p]
        found = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
        return woven(plain, self._words(words), joined([e.ids for e in found], self.kind))

    @staticmethod
    def _simple(words: pa.Array) -> pa.Array:
        return pc.match_substring_regex(words, rf"^[{LETTERS}]+$")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids of each)."""
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        ids, sizes = self.parts.gather(split.flatten(), self._simple, pc.utf8_lower)
        bounds = np.r_[0, np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False))]
        return ids, per_text(sizes, bounds)


_UNITS: dict[tuple[str, str], Units] = {}


def units_of(data: str, kind: str) -> Units:
    """One for each vocabulary and width of ids in a worker process."""
    key = (hashlib.sha256(data.encode()).hexdigest(), kind)
    if key not in _UNITS:
        _UNITS[key] = Units(data, kind)
    return _UNITS[key]


def width_of(data: str, end_id: int) -> str:
    """The narrowest unsigned type that holds every id of the vocabulary: two bytes up to 65,536 ids, else four."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_str(data).get_vocab_size() - 1, end_id) < 1 << 16 else "<u4"


#: One part of the files: its number, the name its files begin with, the ids before it, its documents, tokens and width.
PART = "part int, name string, base long, documents long, tokens long, kind string"


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> tuple[str, list[tuple[int, str, int, int, int, str]]]:
    """Write the files in ascending id order; returns the folder and the parts, see `PART`.

    <name>.bin has the ids as little-endian unsigned integers of `width_of` the vocabulary, <name>.off the 64-bit offset at
    which each document starts within its part, <name>.doc the document ids. A part's base, the number of ids before it,
    is the prefix sum of the parts' totals; the driver sees these totals alone. Each attempt of a task writes files of its
    own, never renamed or written over, and says their name in its totals: those of attempts that are lost or run twice
    are named nowhere, on any store. `folder` must be on a store that pyarrow can write. Rows are dealt by id and a hash
    of the text, so an id that very many rows share is spread too.
    """
    folder = folder or new_path(docs.sparkSession, "tokens")
    with open(tokenizer_path, encoding="utf-8") as file:
        text = file.read()
    kind = width_of(text, end_id)
    data = docs.sparkSession.sparkContext.broadcast(text)
    fs, base_path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base_path, recursive=True)

    def run(batches_of: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = units_of(data.value, kind)
        number = TaskContext.get().partitionId()
        store, base = pafs.FileSystem.from_uri(folder)
        name = f"part-{number:06d}-{uuid.uuid4().hex}"
        streams = {s: store.open_output_stream(f"{base}/{name}.{s}") for s in SUFFIXES}
        documents = tokens = 0
        for batch in batches_of:
            streams["doc"].write(batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            documents += len(batch)
            begun = 0  # ids of the text that the slices before have begun
            for texts, whole in batches(batch.column(1), _BLANK):
                ids, sizes = units.encode(texts)
                if not whole:
                    streams["bin"].write(ids.tobytes())
                    begun += len(ids)
                    continue
                ends = np.cumsum(sizes)
                sizes += 1
                sizes[0] += begun
                begun = 0
                streams["off"].write((tokens + np.cumsum(sizes) - sizes).astype("<i8").tobytes())
                streams["bin"].write(np.insert(ids, ends, end_id).astype(kind, copy=False).tobytes())
                tokens += int(sizes.sum())
            pa.default_memory_pool().release_unused()
        for stream in streams.values():
            stream.close()
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([name]), pa.array([documents], pa.int64()), pa.array([tokens], pa.int64())], ["part", "name", "documents", "tokens"])

    own, text = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), text_or_empty(text_col)
    source = docs.select(own.alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    ordered = source.repartitionByRange("id", "hash").sortWithinPartitions("id", "hash", "text").select("id", "text")
    totals = sorted(tuple(r) for r in ordered.mapInArrow(run, "part int, name string, documents long, tokens long").collect())
    bases = accumulate((t for *_, t in totals), initial=0)
    return folder, [(part, name, base, documents, tokens, kind) for (part, name, documents, tokens), base in zip(totals, bases, strict=False)]


def _flat(store, path: str, kind: str) -> np.ndarray:
    """The file as an array: memory-mapped where it is a local one, else read."""
    if not store.get_file_info(path).size:
        return np.empty(0, kind)
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with store.open_input_file(path) as file:
        return np.frombuffer(file.read(), kind)


def read_token_files(spark: SparkSession, folder: str, parts: list[tuple[int, str, int, int, int, str]], id_col: str = "doc_id") -> DataFrame:
    """One row per document of the files: id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base_path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, base, documents, tokens, kind in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                ids, offsets, doc = (_flat(store, f"{base_path}/{name}.{s}", k) for s, k in zip(SUFFIXES, (kind, "<i8", "<i8"), strict=True))
                if (len(offsets), len(doc), len(ids)) != (documents, documents, tokens):
                    raise ValueError(f"{name} is not as it was written")
                for i in range(0, documents, 4096):
                    starts = np.array(offsets[i : i + 4096])
                    ends = np.append(offsets[i + 1 : i + 4097], tokens)[: len(starts)]
                    crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                    own = np.array(doc[i : i + 4096])
                    yield pa.RecordBatch.from_arrays([pa.array(own, mask=own == NO_ID), pa.array(starts + base), pa.array(ends - starts), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(parts, PART)
    spread = listed.repartition(max(1, len(parts)), "part")
    return spread.mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    """Defined results of both steps: null counts as empty and has the end id alone; null ids come first; rows of
    equal ids come in the order of a hash of the text; strings of special tokens are these tokens, as by the
    library's defaults; an empty table has no rows."""
    import public_tokenizers

    folder, parts = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, folder, parts)
