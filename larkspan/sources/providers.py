"""Recorded answers of search engines as tables, and a Python data source over recorded result pages."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from larkspan.functions import urls
from larkspan.functions.dates import normalize_published
from larkspan.functions.html import result_items, results
from larkspan.functions.text import collapse, strip_tags

#: Where each API's answer has its results and their fields; fixed values.
APIS = {
    "brave": ("web.results", {"title": "title", "url": "url", "snippet": "description"}),
    "searxng": ("results", {"title": "title", "url": "url", "snippet": "content"}),
    "tavily": ("results", {"title": "title", "url": "url", "snippet": "content", "published_at": "published_date"}),
    "exa": ("results", {"title": "title", "url": "url", "snippet": "text", "published_at": "publishedDate"}),
}


def from_api(provider: str, answers: DataFrame) -> DataFrame:
    """(query_id, provider, pos, title, url, snippet, published_at) of (query_id, body): JSON answers of an API."""
    path, fields = APIS[provider]
    item = "struct<title:string,url:string,description:string,content:string,text:string,highlights:array<string>,published_date:string,publishedDate:string>"
    schema = f"array<{item}>"
    for name in reversed(path.split(".")):
        schema = f"struct<{name}:{schema}>"
    parsed = answers.select("query_id", F.from_json("body", schema).alias("j")).select("query_id", F.posexplode(f"j.{path}").alias("pos", "r"))
    snippet = F.col(f"r.{fields['snippet']}")
    if provider == "exa":
        snippet = F.coalesce(F.get(F.col("r.highlights"), F.lit(0)), snippet)
    plain = lambda c: collapse(strip_tags(F.coalesce(c, F.lit(""))))
    date = normalize_published(F.col(f"r.{fields['published_at']}")) if "published_at" in fields else F.lit(None).cast("string")
    rows = parsed.select("query_id", F.lit(provider).alias("provider"), (F.col("pos") + 1).alias("pos"), plain(F.col("r.title")).alias("title"), F.col("r.url").alias("url"), plain(snippet).alias("snippet"), date.alias("published_at"))
    return rows.filter((F.col("title") != "") & (F.coalesce("url", F.lit("")) != ""))


def from_pages(provider: str, pages: DataFrame) -> DataFrame:
    """(query_id, provider, pos, title, url, snippet) of (query_id, html): recorded result pages."""
    rows = pages.select("query_id", F.posexplode(result_items(provider, F.col("html"))).alias("pos", "r"))
    return rows.select("query_id", F.lit(provider).alias("provider"), (F.col("pos") + 1).alias("pos"), "r.title", decoded(provider, F.col("r.url")).alias("url"), "r.snippet")


def decoded(provider: str, url: Column) -> Column:
    return {"duckduckgo": urls.decode_duckduckgo, "bing": urls.decode_bing, "yahoo": urls.decode_yahoo}.get(provider, lambda u: u)(url)


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.engine, self.paths = options["engine"], [p for p in options["paths"].split(",") if p]

    def partitions(self):
        return [_Part(p) for p in self.paths]

    def read(self, partition: _Part) -> Iterator[tuple]:
        with open(partition.path, encoding="utf-8") as file:
            for pos, item in enumerate(results(self.engine, file.read()), 1):
                yield partition.path, pos, item["title"], item["url"], item["snippet"]


class ResultPages(DataSource):
    """Result pages in files: option engine, and paths as a comma list of files that every executor sees."""

    @classmethod
    def name(cls) -> str:
        return "result_pages"

    def schema(self) -> str:
        return "path string, pos int, title string, url string, snippet string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ResultPages)
