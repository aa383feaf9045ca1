from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from larkspan import registry
from larkspan.operators import execution


@pytest.mark.parametrize("name", ["ret8_fallback_execution", "ret9_aggregate_execution", "ret10_plan_execution", "ret11_web_search"])
def test_lists_that_have_a_url_twice(spark, tmp_path, name):
    """Pages 40 apart are results of one query: of each ten such, two have the same url."""
    urls = [f"https://a{i % 40}.example.org/p{(i // 40) % 8}" for i in range(400)]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = registry.QUERIES[name](spark, str(tmp_path))
    known = duckdb.connect()
    known.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    wanted = known.sql(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(wanted)


def test_repeats_go_unless_asked_for(spark):
    rows = [("q", "brave", 0, 1, "https://a.org/"), ("q", "brave", 0, 2, "https://a.org/"), ("q", "brave", 0, 3, "https://b.org/")]
    results = spark.createDataFrame(rows, "query_id string, provider string, provider_ord int, pos int, url string")
    requests = spark.createDataFrame([("q", "words", None)], "query_id string, query string, domain string")
    places = lambda **o: sorted((r.url, r.pos) for r in execution.filtered(results, requests, **o).collect())
    assert places() == [("https://a.org/", 1), ("https://b.org/", 2)]
    assert places(repeats=True) == [("https://a.org/", 1), ("https://a.org/", 2), ("https://b.org/", 3)]
