"""The URL filter against a plain version, its accuracy on hosts it has not seen, and cases at the edges."""

from __future__ import annotations

import math
import re
import zlib

import pytest

from larkspan.llm import url_filter

URL = re.compile(r"(?s)(.*?)://([^/?#]*)([^?#]*)")


def plain(url, model):
    """(host, path, probability) by one pattern and one loop."""
    found = URL.match(url or "")
    host, path = (re.sub("[A-Z]", lambda m: m[0].lower(), found[2]), found[3]) if found else ("", "")
    grams = {zlib.crc32(f"^{t}$".encode()[i : i + n], zlib.crc32(k)) % len(model.weight) for k, t in ((b"h", host), (b"p", path)) for n in (3, 4, 5) for i in range(len(f"^{t}$".encode()) - n + 1)}
    logit = model.bias + (sum(model.weight[g] for g in sorted(grams)) / math.sqrt(len(grams)) if grams else 0)
    return host, path, 1 / (1 + math.exp(-logit))


def test_against_a_plain_version(spark):
    model = url_filter.train(url_filter.labelled_urls())
    urls = [u for u, _ in url_filter.labelled_urls()] + [None, "", "://", "x://", "a://B?c", "A://H#/p", "http://é.example.org/É/ü", "y://" + "long." * 20_000 + "org/x", "http://com/fr/", "http://a.com/de/x"]
    schema = "page_id long, url string, host string, rule string, id string"
    pages = spark.createDataFrame([(i, u, "x", "y", "z") for i, u in enumerate([*urls, urls[0]])], schema).repartition(3)
    got = {r.page_id: r for r in url_filter.judge_urls(pages, model).collect()}
    assert len(got) == len(urls) + 1
    for i, url in enumerate([*urls, urls[0]]):
        host, path, p = plain(url, model)
        fits = [(len(a + b), a + b, says) for a, b, says in url_filter.RULES if re.search(rf"(^|\.){re.escape(a)}$", host) and path.startswith(b)]
        rule, verdict = max(fits)[1:] if fits else (None, "block" if p >= 0.5 else "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict)
        assert got[i].probability == pytest.approx(p, abs=1e-9)
    assert url_filter.judge_urls(pages.limit(0), model).count() == 0


def test_rules_of_one_length(spark):
    """Both fit and are equally long: the smaller string wins, in whatever order they are given."""
    model = url_filter.train([])
    pages = spark.createDataFrame([(1, "http://a.bb/cc")], "page_id long, url string")
    rules = [("bb", "/cc", "block"), ("a.bb", "/", "allow")]
    for given in (rules, rules[::-1]):
        row = url_filter.judge_urls(pages, model, tuple(given)).first()
        assert (row.rule, row.verdict) == min((a + b, v) for a, b, v in rules)


def test_accuracy_on_unseen_hosts():
    rows = url_filter.labelled_urls()
    part = {url: zlib.crc32(url_filter.host_and_path(url)[0].encode()) % 5 for url, _ in rows}
    right = 0
    for fold in range(5):
        model = url_filter.train([r for r in rows if part[r[0]] != fold])
        right += sum((model.probability(*url_filter.host_and_path(u)) >= 0.5) == bool(y) for u, y in rows if part[u] == fold)
    assert right >= 0.8 * len(rows) and len(rows) <= 200
