from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from larkspan import config
from larkspan.operators import fetching
from larkspan.sources import providers

S = "execution_mode string, tenant_id string, workspace_id string"
HERE = ("local", "local", "local")


def test_settings():
    assert config.Limits.of({}) == config.Limits(10, 20)
    assert config.Limits.of({"RATE_LIMIT_SEARCH_PER_MIN": " 7 ", "RATE_LIMIT_FETCH_PER_MIN": ""}) == config.Limits(7, 20)
    for bad in ("0", "-1", "x", "1.5", str(1 << 40)):
        with pytest.raises(ValueError):
            config.Limits.of({"RATE_LIMIT_SEARCH_PER_MIN": bad})
    assert config.together({}, ("A", "B")) is None and config.together({"A": "1", "B": "2"}, ("A", "B")) == {"A": "1", "B": "2"}
    with pytest.raises(ValueError, match="B must be set with A"):
        config.together({"A": "1"}, ("A", "B"))


def test_envelopes():
    assert config.envelope("x") == {"content": [{"type": "text", "text": "x"}]}
    refused = config.rate_limited("web_search", "RATE_LIMIT_SEARCH_PER_MIN", 10, 1500)
    assert refused["isError"] and "10 requests per minute" in refused["content"][0]["text"] and "2 s" in refused["content"][0]["text"]


def test_page_chain(spark):
    rows = [("https://a.org/1", 1, "raw", "A", "raw text"), ("https://a.org/1", 0, "cache", "A", " "), ("https://a.org/2", 2, "html", "B", "page"), ("http://10.0.0.1/", 0, "cache", "C", "secret")]
    candidates = spark.createDataFrame(rows, "url string, ordinal int, origin string, title string, content string")
    asked = spark.createDataFrame([(u,) for u in ("https://a.org/1", "https://a.org/2", "https://a.org/3", "http://10.0.0.1/", "https://a.org/1")], "url string")
    got = {r.url: r for r in fetching.page_chain(asked, candidates).collect()}
    assert len(got) == 4 and (got["https://a.org/1"].origin, got["https://a.org/2"].content, got["https://a.org/3"].error) == ("raw", "page", "no_content")
    assert got["http://10.0.0.1/"].error == "private_host" and got["http://10.0.0.1/"].content is None


def test_raw_articles(spark):
    rows = [("https://r.test/a-b.md", 0, "short"), ("https://r.test/a-b.md", 1, "# Head\n\nsome **bold** text that is long"), ("https://r.test/none", 0, None), ("https://r.test/my-file", 0, "plain text that is long enough")]
    got = {r.url: r for r in fetching.raw_articles(spark.createDataFrame(rows, "url string, ordinal int, raw string")).collect()}
    assert set(got) == {"https://r.test/a-b.md", "https://r.test/my-file"}
    assert got["https://r.test/a-b.md"].title == "Head" and "some bold text" in got["https://r.test/a-b.md"].content and got["https://r.test/a-b.md"].ordinal == 1
    assert got["https://r.test/my-file"].content.startswith("# my file\n\n")


def test_kept_articles(spark):
    old = spark.createDataFrame([(*HERE, "https://a.org/x", "old", "general", 1, None)], f"{S}, url string, content string, category string, ts long, published_at string")
    new = spark.createDataFrame([(*HERE, "https://a.org/x", "t", "new​ text"), ("hosted", "t", "w", "https://docs.a.org/guide", "t", "other")], f"{S}, url string, title string, content string")
    got = {(r.tenant_id, r.url): r for r in fetching.keep_articles(old, new, F.lit(5)).collect()}
    assert len(got) == 2 and got[("local", "https://a.org/x")].content == "new text" and got[("t", "https://docs.a.org/guide")].category == "docs"


def test_api_answers(spark):
    rows = [(1, '{"results": [{"title": "<b>A</b>  x", "url": "https://a", "text": "long", "highlights": ["best"], "publishedDate": "2024-03-01T00:00:00Z"}, {"title": "", "url": "https://b"}, {"title": "C"}]}'), (2, "not json"), (3, '{"results": []}')]
    got = providers.from_api("exa", spark.createDataFrame(rows, "query_id long, body string")).collect()
    assert [(r.query_id, r.pos, r.title, r.snippet, r.published_at) for r in got] == [(1, 1, "A x", "best", "2024-03-01")]


def test_bytes_are_decoded_by_what_the_page_declares(spark):
    meta = lambda name, text: f'<meta charset="{name}">{text}'.encode(name)
    rows = [
        (1, meta("windows-1252", "“quoted” – 5 €"), "text/html; charset=utf-8", '<meta charset="windows-1252">“quoted” – 5 €'),
        (2, meta("shift_jis", "日本語"), None, '<meta charset="shift_jis">日本語'),
        (3, "žluť".encode("iso-8859-2"), "text/html; charset=ISO-8859-2", "žluť"),
        (4, "é €".encode(), "text/html", "é €"),
        (5, b"\x81x", "text/html; charset=windows-1252", "�x"),
        (6, "é".encode(), "text/html; charset=nobody-knows", "é"),
        (7, "Привет".encode("koi8-r"), "text/html; charset='koi8-r'", "Привет"),
        (8, b"caf\xe9", "text/html; charset=latin1", "café"),
        (9, None, None, None),
        (10, b"", None, ""),
    ]
    frame = spark.createDataFrame([r[:3] for r in rows], "id long, raw binary, kind string")
    got = {r.id: r.text for r in frame.select("id", fetching.decoded(F.col("raw"), F.col("kind")).alias("text")).collect()}
    assert got == {r[0]: r[3] for r in rows}
