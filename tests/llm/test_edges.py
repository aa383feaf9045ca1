"""Nulls, empty tables, very long texts, repeated rows, clashing columns and crowds, operator by operator."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from larkspan.llm import bpe, chat, mixing, parts, simhash, token_files
from larkspan.llm.suffix_dedup import remove_repeats
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_chat_long_texts_and_a_hot_conversation(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"turn {t} </s> \\ [INST]") for t in range(2000)] + [(2, 0, "assistant", "x[/TURN]" * 200_000), (3, 0, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    pieces = chat.format_conversations(turns, most_chars=5000).cache()
    got = {r.conv: r for r in chat.read_back(pieces, sum(map(len, chat.frame()))).collect()}
    for conv in (1, 2, 3):
        own = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        said = "".join(t for r, t in own if r == "assistant")
        assert got[conv].n_turns == len(own) and got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_chat_query_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string, conv string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r.conv_id for r in chat.op2_chat_format(spark, str(tmp_path)).collect()] == [-1]


def test_bpe_clashing_columns_and_repeated_rows(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.createDataFrame([(1, "a b", "i", "t", "n"), (1, "a b", "i", "t", "n"), (None, None, "i", "t", "n")], "doc_id long, text string, id string, ids string, n_tokens string")
    rows = bpe.encode_decode(docs, path, public_tokenizers.PATTERN).collect()
    assert len(rows) == 3 and sorted(r.n_tokens for r in rows) == [0, 2, 2]
    assert bpe.encode_decode(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("most", [3, 1000])
def test_bpe_in_stretches_and_other_patterns(most):
    ranks, own = library()
    rng = random.Random(most)
    text = " ".join("".join(rng.choice("abcdetTHé.,'") for _ in range(rng.randint(1, 9))) for _ in range(4000)) + "x" * 3000 + "\n\n end"
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN, most)
    ids = []
    for piece, _ in parts.batches(pa.array([text]), bpe._CUT, 64):
        ids += encoder.encode_all(piece)[0].tolist()
    assert ids == own.encode_ordinary(text) and own.decode(ids) == text
    other = r"\p{L}+|\s|[^\s\p{L}]"
    assert bpe.Encoder(ranks, other, most).encode(text) == tiktoken.Encoding("o", pat_str=other, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)
    assert bpe.BLANKS_BEGIN == public_tokenizers.PATTERN


def test_parts_forget_and_learn_again():
    store = parts.Parts("<i4", lambda texts: parts.joined([[len(t), ord(t[0])] if t else [] for t in texts], "<i4"), 4)
    for word in "a b c d e f a b a b g h i a".split():
        got, sizes = store.gather(pa.array([word, word + "x"]), lambda w: pa.array(np.zeros(len(w), bool)), None)
        assert got.tolist() == [1, ord(word), 2, ord(word)] and sizes.tolist() == [2, 2]
        assert len(store.number) <= 4 + 3


def test_token_files_ignore_dead_attempts_and_keep_widths_apart(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(i // 3, f"some words {i % 4}") for i in range(60)] + [(None, "w")] * 5, "doc_id long, text string").repartition(5)
    folder = f"file://{tmp_path}/tokens"
    (tmp_path / "tokens").mkdir()
    for suffix in token_files.SUFFIXES:
        (tmp_path / "tokens" / f"part-000000-dead.{suffix}").write_bytes(b"12345678")
    _, listed = token_files.write_token_files(docs, path, folder=folder)
    again = token_files.write_token_files(docs, path, folder=folder)[1]
    first, second = (sorted(tuple(r) for r in token_files.read_token_files(spark, folder, p).collect() if r.doc_id is not None) for p in (listed, again))
    assert first == second and len(first) == 60
    # One worker process, two widths of ids.
    wide = token_files.write_token_files(docs, path, end_id=1 << 20)[1]
    narrow = token_files.write_token_files(docs, path)[1]
    assert {p[-1] for p in wide} == {"<u4"} and {p[-1] for p in narrow} == {"<u2"}
    own = Tokenizer.from_file(path)
    folder, listed = token_files.write_token_files(docs, path, end_id=1 << 20)
    for r in token_files.read_token_files(spark, folder, listed).filter("doc_id IS NULL").collect():
        assert r.ids_crc32 == zlib.crc32(np.array([*own.encode("w", add_special_tokens=False).ids, 1 << 20], "<u4").tobytes())


def test_units_of_a_long_text():
    path = public_tokenizers.path("word_bpe_49k.json")
    data = open(path, encoding="utf-8").read()
    own = Tokenizer.from_file(path)
    text = "Some words, " * 3000 + "ÉTÉ ÀÇ ΣΑΣ. 12"
    units, ids = token_files.Units(data, "<u2", most=4), []
    for piece, _ in parts.batches(pa.array([text]), token_files._BLANK, 100):
        ids += units.encode(piece)[0].tolist()
    assert ids == own.encode(text, add_special_tokens=False).ids


def test_simhash_of_texts_over_a_piece():
    """Shingles go over the joints of the pieces that a huge text is cut into."""
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 12))) for _ in range(180_000))
    assert len(text) > 1 << 20 and simhash.fingerprint(text.encode(), 4) == brute.simhash(text)
    assert simhash.fingerprint(("x" * (1 << 21)).encode(), 4) == brute.simhash("x" * (1 << 21))


def test_simhash_crowded_buckets_through_the_whole_query(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(120):
        words = list(base)
        words[rng.randrange(400)] = f"z{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in simhash.simhash_groups(docs, most=8).collect()), key=repr)
    assert got == brute.simhash_groups(rows)


def test_mixing_a_very_long_text(spark):
    """What rounding it adds or takes, the small ones make up."""
    docs = spark.createDataFrame([(1, "w " * 400_000, "a"), *((i, "w " * 50, "a") for i in range(2, 9000)), (9000, "x", "b")], "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    target, taken = rows[0].target, sum(r.taken for r in rows if r.source_size > 1)
    assert next(r for r in rows if r.doc_id == 1).size == 400_000 and all(r.taken <= 2 * r.size for r in rows)
    assert abs(taken - max(r.target for r in rows)) <= 100 and target > 0


def test_mixing_rates_solve_the_dual(spark):
    """Of each source log(rate) is proportional to size below the limit, and rates times sizes come to the target."""
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, "w " * rng.randint(1, 60), rng.choice("abcd")) for i in range(600)], "doc_id long, text string, source string")
    by_source: dict = {}
    for r in mixing.mix(docs).collect():
        by_source.setdefault(r.source_size, []).append(r)
    for rows in by_source.values():
        assert sum(r.rate * r.size for r in rows) == pytest.approx(rows[0].target, rel=1e-5)
        slopes = {round(float(np.log(r.rate)) / r.size, 4) for r in rows if 0.01 < r.rate < 1.999}
        assert len(slopes) <= 2
    given = docs.selectExpr("*", "CASE WHEN doc_id % 2 = 0 THEN 0.5 END AS prior")
    for r in mixing.mix(given, prior_col="prior").collect():
        assert 0 <= r.copies <= 2


def test_mixing_rows_that_share_an_id(spark):
    rows = [(1, "a b c", "en", "s", 1), (1, "d e", "en", "s", 1), (1, "a b c", "en", "s", 1), (None, "x y", "en", "s", 1), (None, None, "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    shares = mixing.mix(docs).collect()
    applied = mixing.apply_mix(docs)
    assert applied.columns == docs.columns and applied.count() == sum(r.copies for r in shares if r.copies)
    near = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert near.columns == docs.columns and {r.text for r in near.collect()} <= {r[1] for r in rows}


def test_repeats_at_full_length(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    passages = [word(n) for n in (330, 360, 380, 420, 900, 1500)]
    rows = []
    for i in range(40):
        pieces = [word(rng.randint(0, 500)) for _ in range(3)] + rng.sample(passages, rng.randint(0, 3))
        rng.shuffle(pieces)
        rows.append((i, "".join(pieces)))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, body string")
    got = sorted((tuple(r) for r in remove_repeats(docs).drop("kept").collect()), key=repr)
    assert got == brute.remove_repeats(rows, 400) and sum(r[2] for r in got) > 0


def test_nothing_but_the_query_module_falls_back_to_a_local_folder():
    source = open(corpus_pipeline.__file__, encoding="utf-8").read()
    assert not re.search(r"tempfile|localCheckpoint|except ImportError", source)
