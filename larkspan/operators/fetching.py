"""Pages from recorded sources in order of preference, raw Markdown articles, and keeping what was read."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from larkspan.functions import urls
from larkspan.functions.routing import category
from larkspan.functions.text import markdown_title, strip_markdown, truncate, visible
from larkspan.operators.changes import upsert
from larkspan.operators.ranking import first_per
from larkspan.schemas import SCOPE

#: A raw candidate shorter than this is no article; a fixed value.
LEAST = 20


def page_chain(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """(url, ordinal, origin, title, content, error) for each requested url.

    candidates: (url, ordinal, origin, title, content), what each source of the chain recorded, the first with a content
    wins. An address that isn't public is refused before any source is looked at; one without any content is `no_content`.
    """
    asked = requests.select("url").distinct().withColumn("verdict", urls.public_address(F.col("url")))
    found = candidates.filter(F.trim(F.coalesce("content", F.lit(""))) != "")
    best = first_per(found, ["url"], ["ordinal"])
    joined = asked.join(best, "url", "left")
    good = F.col("verdict") == "ok"
    error = F.when(~good, F.col("verdict")).when(F.col("content").isNull(), "no_content")
    return joined.select("url", *(F.when(good, F.col(c)).alias(c) for c in ("ordinal", "origin", "title", "content")), error.alias("error"))


#: Names of character sets that Spark itself reads; fixed values. All others go by Python's codecs.
LATIN, UTF = ("iso-8859-1", "latin1"), ("utf-8", "utf8", "us-ascii", "ascii")


@F.pandas_udf(StringType())
def _by_codec(raw: pd.Series, charset: pd.Series) -> pd.Series:
    def text(data: bytes | None, name: str) -> str | None:
        if data is None:
            return None
        try:
            return bytes(data).decode(codecs.lookup(name).name, "replace")
        except (LookupError, UnicodeError):
            return bytes(data).decode("utf-8", "replace")

    return pd.Series([text(d, n) for d, n in zip(raw, charset, strict=True)], dtype=object)


def decoded(raw: Column, content_type: Column) -> Column:
    """The text of a page's bytes: by the character set that its first 2,048 bytes declare, else by the one its type names,
    else as UTF-8. Bytes that the set has not become U+FFFD; a set that nobody knows is taken for UTF-8."""
    named = lambda c: F.nullif(F.lower(F.regexp_extract(c, r"(?i)charset=[\"']?\s*([a-zA-Z0-9_-]+)", 1)), F.lit(""))
    head = F.decode(F.substring(raw, 1, 2048), "iso-8859-1")
    declared = F.coalesce(named(F.regexp_extract(head, r"(?is)<meta[^>]+charset[^>]*>", 0)), named(F.coalesce(content_type, F.lit(""))), F.lit("utf-8"))
    other = ~declared.isin(*LATIN, *UTF)
    # Only bytes of other sets cross to Python.
    rest = _by_codec(F.when(other, raw), declared)
    return F.when(declared.isin(*LATIN), F.decode(raw, "iso-8859-1")).when(other, rest).otherwise(F.decode(raw, "utf-8"))


def reader_page(answer: Column, least: int = 50) -> Column:
    """struct<title, content> of a reader's answer, null where its content is too short to be a page."""
    content = F.regexp_extract(answer, r"(?s)Markdown Content:\n(.*)$", 1)
    page = F.struct(F.trim(F.regexp_extract(answer, r"(?m)^Title:\s*(.+)$", 1)).alias("title"), content.alias("content"))
    return F.when(F.length(content) >= least, page)


def raw_articles(candidates: DataFrame) -> DataFrame:
    """(url, ordinal, title, content) of (url, ordinal, raw): the first raw Markdown of each url that is long enough, as
    text under its heading; without a heading the url names it."""
    good = candidates.filter(F.length(F.trim(F.coalesce("raw", F.lit("")))) >= LEAST)
    best = first_per(good, ["url"], ["ordinal"])
    title = F.coalesce(F.nullif(markdown_title(F.col("raw")), F.lit("")), urls.title_from_url(F.col("url")))
    named = best.withColumn("title", title)
    return named.select("url", "ordinal", "title", truncate(F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), strip_markdown(F.col("raw")))).alias("content"))


def keep_articles(pages: DataFrame, articles: DataFrame, at: Column) -> DataFrame:
    """The content cache (scope, url, content, category, ts, published_at) after articles (scope, url, title, content) are
    kept: without invisible characters, in the category that url and title tell."""
    text = visible(F.col("content"))
    new = articles.select(*SCOPE, "url", text.alias("content"), category(F.col("url"), F.concat_ws(" ", "title", F.substring(text, 1, 200))).alias("category"), at.cast("long").alias("ts"), F.lit(None).cast("string").alias("published_at"))
    return upsert(pages, new, [*SCOPE, "url"], "ts")
