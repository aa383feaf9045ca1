from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larkspan.llm import bpe, chat, quality, token_files, url_filter
from larkspan.llm.template import Escaper, Template, TemplateError

ODD = ["", " ", "  two  spaces\n\n\nx \n y\t z", "a\x1cb \x1c c", "a" * 500, " " * 50 + "x", "日本語🙂🙂 é́ İ x\x85y\xa0\xa0z", "it's we'll 'S 123456 ٣٤", "\0a\0 b", "<|endoftext|> [INST]", "İstanbul ΣΑΣ. Élan. é́. don't ha.... 1. ﬁ. Ǆ. \x1c. a b. 　 ", "word " * 20_000]


def test_bpe_agrees_with_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    texts = [*ODD, "".join(map(chr, range(1, 3000))), *("".join(rng.choice("abcdeTHE  \n.,'é") for _ in range(200)) for _ in range(60))]
    docs = spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.encode_decode(docs, path, public_tokenizers.PATTERN).collect()}
    for i, text in [*enumerate(texts), (-1, "")]:
        ids = own.encode_ordinary(text)
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_with_few_states_and_small_memory():
    ranks = bpe.parse_ranks(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN, most=5)
    encoder.transducer.most_states = 20
    for text in ODD:
        assert encoder.encode(text) == own.encode_ordinary(text)


def test_streaming_decoder():
    decoder = bpe.Decoder({b: bytes([b]) for b in range(256)})
    text = "aé日🙂"
    out = [s for byte in text.encode() for s in decoder.decode([byte])]
    assert "".join(out) == text and decoder.end() == ""
    for bad in (b"\xc0a", b"\xe2\x82", b"\xf0\x9f\x98", b"\x80", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xe2\x82a"):
        assert "".join(decoder.decode(list(bad))) + decoder.end() == bad.decode("utf-8", "replace")


def test_token_files(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    special = ["end <|endoftext|> more", "a<|startoftext|>b<|endoftext|>.", "<|ENDOFTEXT|> <|endoftext |>", "x <|endoftext|>\n<|endoftext|>!é́<|endoftext|>\u0301"]
    assert own.encode(special[0], add_special_tokens=False).ids[1] == 49407
    rows = [*((i * 7 % 101, t) for i, t in enumerate(ODD)), *((400 + i, t) for i, t in enumerate(special)), (200, None), (None, "null id"), (300, "same"), (300, "same")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, start string").repartition(4)
    folder, parts = token_files.write_token_files(docs, path)
    got = [tuple(r) for r in token_files.read_token_files(spark, folder, parts).orderBy("start").collect()]
    start = 0
    for (i, text), row in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), got, strict=True):
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 1]
        assert row == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    folder, parts = token_files.write_token_files(docs.limit(0), path)
    assert token_files.read_token_files(spark, folder, parts).count() == 0


def test_template_language():
    t = Template("{# c #}{% if true and 1 == 1 %}A{{ 'b' + 'c' | upper }}{% else %}{{ x }}{% endif %}{% for m in messages %}[{{ m.role }}{% if 'y' in m.text %}!{% elif not m.text %}0{% endif %}{% generation %}{{ m.text | trim }}{% endgeneration %}]{% endfor %}")
    assert len(t.tree) == 2  # the condition is folded away, its text joined
    assert t.render([{"role": "u", "text": " y "}, {"role": None, "text": ""}]) == ("AbC[u!y][0]", [(6, 7), (10, 10)])
    for bad in ("{% for m in messages %}", "{{ m.__class__ }}", "{{ open('x') }}", "{{ a | import }}", "{% while 1 %}", "{% if x %}", "{{ 1 + }}", "{{ messages[0] }}"):
        with pytest.raises(TemplateError):
            Template(bad)
    with pytest.raises(TemplateError):
        Template("{{ y }}").render([])


def test_escaping_comes_back():
    escaper, rng = Escaper(chat.CONTROLS), random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice(["<", "/", "s", ">", "[", "INST", "]", "\\", "[/INST]", "</s>", " ", "\n", "é"]) for _ in range(rng.randint(0, 12)))
        escaped = escaper.escape(text)
        assert escaper.unescape(escaped) == text and not any(c in escaped for c in chat.CONTROLS)


def test_chat_round_trip(spark):
    rng = random.Random(8)
    rows = [(i % 9, rng.randint(0, 40), rng.choice(["user", "assistant", "system", "a]b", None, "[TEXT]"]), rng.choice([None, "", " x ", "</s>[INST] ok [/INST]", "a\\b", "\\", "[TURN]\n"])) for i in range(300)]
    rows += [(None, 1, "assistant", "n"), (None, None, "user", "m"), (50, 0, "assistant", "q"), (50, 0, "assistant", "q")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, pieces int")
    pieces = chat.format_conversations(turns, most_chars=40)
    got = {r.conv: r for r in chat.read_back(pieces, sum(map(len, chat.frame()))).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        said = "".join(x for _, _, r, x in own if r == "assistant")
        whole, spans = Template(chat.TEMPLATE, chat.CONTROLS).render([{"role": r, "text": x} for _, _, r, x in own])
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in own).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert got[conv].formatted_chars == len(whole)
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0


def test_quality(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, labels = [], []
    for i in range(400):
        bad = i % 2
        rows.append((i, " ".join(word() + ("$$$" if bad else "") for _ in range(30)), 1))
        labels.append((i, 1 - bad, 0))
    rows += [(1000, None, 1), (1001, "", 1), (None, "x", 1), (7, rows[7][1], 1)]
    labels += [(5000, 1, 0), (None, 1, 0), (3, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(docs, known)
    out = quality.score_documents(docs, model).collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if r.doc_id is not None and r.doc_id < 400:
            assert r.predicted == 1 - r.doc_id % 2
    good = quality.keep_good(docs, model)
    assert good.columns == docs.columns and sorted(r.doc_id for r in good.filter("doc_id < 400").collect()) == list(range(0, 400, 2))
    again = quality.fit(docs.repartition(3), known)
    assert np.array_equal(model.weight, again.weight)
    flat = quality.score_documents(docs, quality.fit(docs, known.limit(0))).agg(F.countDistinct("score")).first()[0]
    assert flat == 1


def test_url_filter(spark):
    model = url_filter.train(url_filter.labelled_urls())
    hits = sum((model.probability(*url_filter.host_and_path(u)) >= 0.5) == bool(y) for u, y in url_filter.labelled_urls())
    assert hits >= 0.97 * len(url_filter.labelled_urls())
    urls = ["https://A.Example.ORG/es/1?x#y", "http://x.com/fr/", "http://com/de/2", "ftp://xcom/fr/", None, "", "no scheme", "https://h.org", "https://h.org?q=/x", "https://h.org/#/a", "http://a://b/c", "https://www.cheap-pills.example.net/a", "x" * 10_000 + "://example.org/en/1\n2"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, urls[0], "h")], "page_id long, url string, host string")
    got = url_filter.judge_urls(pages, model).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        host, path = url_filter.host_and_path(urls[r.page_id if r.page_id is not None else 0])
        fit = [(len(a + b), a + b, v) for a, b, v in url_filter.RULES if (host == a or host.endswith("." + a)) and path.startswith(b)]
        rule, verdict = max(fit)[1:] if fit else (None, "block" if model.probability(host, path) >= 0.5 else "allow")
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)
    assert {r.page_id: r.verdict for r in got}[11] == "block"
