"""Golden pairs of the functions, each through a one-row table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from larkspan.functions import dates, html, routing, text, urls
from larkspan.functions.chunks import chunk
from larkspan.functions.entities import extract
from larkspan.sources import documents


def value(spark, expression, **columns):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]) if columns else spark.range(1)
    return row.select(expression.alias("v")).first().v


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://www.Example.com/docs/?utm_source=test&b=2&a=1#intro", "https://example.com/docs?a=1&b=2"),
        ("https://example.com/#/article-a", "https://example.com/#/article-a"),
        ("https://example.com/#!/article-b", "https://example.com/#!/article-b"),
        ("https://example.com/docs#intro", "https://example.com/docs"),
        ("https://example.com/search?b=2&id=primary&id=fallback&a=1", "https://example.com/search?a=1&b=2&id=primary&id=fallback"),
        ("https://example.com:443/", "https://example.com"),
        (" not a url ", "not a url"),
    ],
)
def test_normalised_urls(spark, url, want):
    assert value(spark, urls.normalize(F.col("u")), u=url) == want


def test_domains_and_decoders(spark):
    match = lambda u: value(spark, urls.domain_matches(F.col("u"), F.lit("react.dev")), u=u)
    assert [match(u) for u in ("https://react.dev/a", "https://engineering.react.dev/", "https://example.com", "nope")] == [True, True, False, False]
    assert value(spark, urls.decode_duckduckgo(F.lit("//duckduckgo.com/l/?uddg=https%3A%2F%2Faltin.doviz.com%2F"))) == "https://altin.doviz.com/"
    assert len(value(spark, urls.github_raw(F.lit("https://github.com/a/b")))) == 6
    assert value(spark, urls.github_raw(F.lit("https://github.com/a/b/blob/main/x/y.md"))) == ["https://raw.githubusercontent.com/a/b/main/x/y.md"]
    verdicts = {"http://10.0.0.1/": "private_host", "https://example.org": "ok", "ftp://a.b/": "unsupported_protocol", "x": "invalid_url", "http://[::1]/": "private_host", "http://172.20.1.1": "private_host", "http://172.32.1.1": "ok"}
    assert {u: value(spark, urls.public_address(F.lit(u))) for u in verdicts} == verdicts


@pytest.mark.parametrize(("shown", "want"), [("Updated Mar 15, 2024 by", "2024-03-15"), ("Posted 15 March 2024", "2024-03-15"), ("on 2024-02-31 x", "2024-02-31"), ("3 days ago", "2025-06-12"), ("none", None), ("Mar 45, 2024", None)])
def test_publish_dates(spark, shown, want):
    assert value(spark, dates.publish_date(F.col("t"), F.lit("2025-06-15").cast("date")), t=shown) == want


def test_date_ranges(spark):
    keep = lambda d: value(spark, dates.within(F.lit(d).cast("string"), "2024-01-01", None))
    assert [keep(d) for d in ("2024-05-01", "2020-01-01", None)] == [True, False, True]
    assert value(spark, dates.normalize_published(F.lit("D:20240230"))) is None


def test_queries(spark):
    assert value(spark, text.rewrite_query(F.lit("How to tune pg"))) == "tune pg postgres"
    found = value(spark, text.expand_query(F.lit("db backup strategy"), 3))
    assert found[0] == "db backup strategy" and 2 <= len(found) <= 4
    assert len(value(spark, text.expand_query(F.lit("js framework performance"), 1))) == 2
    assert value(spark, text.expand_query(F.lit("elections"), 2, F.lit("news"), 2025)) == ["elections", "elections 2025"]
    plan = value(spark, routing.plan(F.lit("technical"), F.array(*map(F.lit, ("duckduckgo", "bing", "brave", "google")))))
    assert (plan.strategy, plan.primary, plan.fallback) == ("aggregate", ["brave", "duckduckgo"], ["bing", "google"])
    plan = value(spark, routing.plan(F.lit("news"), F.array(*map(F.lit, ("duckduckgo", "marginalia", "bing")))))
    assert plan.primary == ["duckduckgo", "bing", "marginalia"]
    assert value(spark, routing.heuristic_intent(F.lit("latest price"))) is None


def test_answers_parts(spark):
    assert value(spark, text.sentences(F.lit("First sentence is here. Second sentence follows it! no"))) == ["First sentence is here.", "Second sentence follows it! no"]
    newest = value(spark, text.newest_version(F.lit("Node.js 22.4.1 and js 20.1 and v 22.4")))
    assert (newest.name, newest.major, newest.minor, newest.patch) == ("js", 22, 4, 1)


def test_entities():
    assert extract("Redis and Redis support PostgreSQL.") == [("Redis", 2), ("PostgreSQL", 1)]
    assert extract("React Native uses React and React.") == [("React", 2), ("React Native", 1)]
    assert extract("Node.js SDK works with Redis.") == [("Node.js SDK", 1), ("Redis", 1)]
    assert dict(extract("PostgreSQL. Redis!")) == dict(extract("PostgreSQL\nRedis")) == {"PostgreSQL": 1, "Redis": 1}
    assert extract(None) == extract("  ") == []


def test_chunks():
    assert chunk(" \n ") == [] and chunk("short") == ["short"]
    three = "\n\n".join(["paragraph " * 10] * 3)
    assert len(chunk(three, most=120)) >= 2
    assert all(len(c) <= 480 for c in chunk("A sentence of some length. " * 200, most=400))


def test_html_and_documents(tmp_path):
    page = "<html><head><title>T</title></head><body><div hidden>no</div><script>x</script><article><h1>Head</h1><p>" + "word " * 80 + "</p><ul><li>a<li>b</ul></article></body></html>"
    assert html.article(page)["title"] == "T" and "no" not in html.article(page)["content"].split()
    assert "# Head" in html.to_markdown(page)["text"] and "*   a" in html.to_markdown(page)["text"]
    assert html.article("<p>short</p>") is None
    assert html.feed("<rss><item><title>A &amp; B</title><link>http://x</link></item></rss>") == [{"title": "A & B", "url": "http://x", "snippet": ""}]
    lite = '<table><tr><td><a class="result-link" href="//duckduckgo.com/l/?uddg=x">T</a></td></tr><tr><td class="result-snippet">S</td></tr></table>'
    assert html.results("duckduckgo", lite) == [{"title": "T", "url": "https://duckduckgo.com/l/?uddg=x", "snippet": "S"}]
    import io
    import zipfile

    def zipped(files):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            for name, body in files.items():
                z.writestr(name, body)
        return buffer.getvalue()

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    made = zipped({"word/document.xml": f"<w:document {w}><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:document>"})
    assert documents.extract(made)["text"] == "One\n\nTwo"
    opf = '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Book</dc:title></metadata><manifest><item id="a" href="c/1.xhtml"/></manifest><spine><itemref idref="a"/></spine></package>'
    book = zipped({"mimetype": "application/epub+zip", "META-INF/container.xml": '<container><rootfile full-path="o/p.opf"/></container>', "o/p.opf": opf, "o/c/1.xhtml": "<body><p>Hi</p></body>"})
    assert documents.extract(book) == {"format": "epub", "title": "Book", "text": "Hi", "error": None}
    assert documents.extract(b"PK\x03\x04broken")["error"] == "invalid_document"
    assert documents.extract(b"\0\1", "a.bin")["error"] == "unsupported_format"
    assert documents.allowed_dirs("~/a, /b", "/home/u") == ["/home/u/a", "/b"]
