"""Scalar functions over whole columns: text, URLs, dates, routing, extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.catalog import query, table
from larkspan.functions import chunks, dates, entities, html, routing, text, urls
from larkspan.operators import fetching
from larkspan.plans.bases import base, sub
from larkspan.plans.ranking import KEY

_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))"


@query("flt3_normalised_domain", f"SELECT page_id, regexp_replace({_HOST}, '^www\\.', '') AS domain FROM pages")
def flt3_normalised_domain(spark, d):
    return table(spark, d, "pages").select("page_id", urls.normalize_domain(F.col("url")).alias("domain"))


@query("flt4_domain_match", f"SELECT page_id FROM pages WHERE regexp_replace({_HOST}, '^www\\.', '') = 'example.org' OR {_HOST} LIKE '%.example.org'")
def flt4_domain_match(spark, d):
    return table(spark, d, "pages").filter(urls.domain_matches(F.col("url"), F.lit("https://www.Example.org/"))).select("page_id")


@query("fns17_normalised_url", f"SELECT page_id, {KEY} AS key FROM pages")
def fns17_normalised_url(spark, d):
    return table(spark, d, "pages").select("page_id", urls.normalize(F.col("url")).alias("key"))


@query("fns18_tags_stripped", "SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '[\\s]+', ' ', 'g')) AS text FROM pages")
def fns18_tags_stripped(spark, d):
    return table(spark, d, "pages").select("page_id", text.collapse(text.strip_tags(F.col("html"))).alias("text"))


@query("fns19_absolute_url", "SELECT page_id, 'https://' || regexp_extract(url, '://(.*)$', 1) AS full_url, true AS is_url FROM pages")
def fns19_absolute_url(spark, d):
    relative = F.regexp_replace("url", "^[a-z]+:", "")
    return table(spark, d, "pages").select("page_id", urls.absolute(relative, F.lit("https://a.test")).alias("full_url"), urls.is_url(F.col("url")).alias("is_url"))


@query("fns21_title_from_url", f"""
SELECT page_id, CASE WHEN p IS NULL OR p = '' THEN {_HOST} ELSE regexp_replace(p, '[-_]', ' ', 'g') END AS title
FROM (SELECT *, regexp_extract(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', ''), '([^/]*)$', 1) AS p FROM pages)""")
def fns21_title_from_url(spark, d):
    return table(spark, d, "pages").select("page_id", urls.title_from_url(F.col("url")).alias("title"))


@query("flt13_public_address", "SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') THEN 'ok' ELSE 'unsupported_protocol' END AS verdict FROM pages")
def flt13_public_address(spark, d):
    return table(spark, d, "pages").select("page_id", urls.public_address(F.col("url")).alias("verdict"))


@query("src21_redirect_decoders", "SELECT page_id, url AS ddg, url AS yahoo FROM pages")
def src21_redirect_decoders(spark, d):
    pages = table(spark, d, "pages")
    ddg = F.concat(F.lit("//duckduckgo.com/l/?uddg="), F.url_encode("url"))
    yahoo = F.concat(F.lit("https://r.search.yahoo.com/x/RU="), F.url_encode("url"), F.lit("/RK=2/"))
    return pages.select("page_id", urls.decode_duckduckgo(ddg).alias("ddg"), urls.decode_yahoo(yahoo).alias("yahoo"))


@query("src21_bing_decoder", "SELECT page_id, url AS target FROM pages")
def src21_bing_decoder(spark, d):
    wrapped = F.concat(F.lit("https://www.bing.com/ck/a?u=a1"), F.translate(F.rtrim(F.base64(F.col("url").cast("binary")), F.lit("=")), "+/\n\r", "-_"))
    return table(spark, d, "pages").select("page_id", urls.decode_bing(wrapped).alias("target"))


@query("src15_github_candidates", """
SELECT doc_id, u AS candidate FROM (SELECT doc_id, source, unnest(['main', 'master']) AS b FROM documents), (VALUES ('README.md'), ('readme.md'), ('Readme.md')) n(f),
LATERAL (SELECT 'https://raw.githubusercontent.com/org/' || source || '/' || b || '/' || f AS u)""")
def src15_github_candidates(spark, d):
    repo = F.concat(F.lit("https://github.com/org/"), F.col("source"))
    return table(spark, d, "documents").select("doc_id", F.explode(urls.github_raw(repo)).alias("candidate"))


@query("src16_feed_candidates", """
SELECT doc_id, len(u) AS n, u[2] AS first FROM (SELECT doc_id, ['x', 'https://' || source || '.example.org/feed.xml', 'a', 'b', 'c', 'd', 'e'] AS u FROM documents)""")
def src16_feed_candidates(spark, d):
    found = urls.feed_candidates(F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/blog/")))
    return table(spark, d, "documents").select("doc_id", F.size(found).alias("n"), F.get(found, F.lit(1)).alias("first"))


@query("fns2_query_terms", """
SELECT item_id, i AS at, t[i] AS term, i = len(t) AS is_prefix FROM (SELECT item_id, list_filter(string_split_regex(text, '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') AS t FROM benchmark), LATERAL (SELECT unnest(range(1, len(t) + 1)) AS i)""")
def fns2_query_terms(spark, d):
    terms = table(spark, d, "benchmark").select("item_id", text.fts_terms(F.col("text")).alias("t"))
    return terms.select("item_id", F.size("t").alias("n"), F.posexplode("t").alias("p", "term")).select("item_id", (F.col("p") + 1).cast("long").alias("at"), "term", (F.col("p") + 1 == F.col("n")).alias("is_prefix"))


@query("fns4_note_tokens", f"SELECT id, list_transform(list_filter(string_split_regex(text, '[^\\p{{L}}\\p{{N}}_]+'), lambda x: len(x) >= 2), lambda x: lower(x)) AS tokens FROM {sub('notes')}")
def fns4_note_tokens(spark, d):
    return base(spark, d, "notes").select("id", text.note_tokens(F.col("text")).alias("tokens"))


_STOP = "[" + ",".join(f"'{w}'" for w in text.STOPWORDS) + "]"


@query("fns5_meaningful_terms", f"""
SELECT item_id, list_sort(list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: len(x) >= 3 AND NOT list_contains({_STOP}, x)))) AS terms FROM benchmark""")
def fns5_meaningful_terms(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_sort(text.meaningful_terms(F.col("text"))).alias("terms"))


_PARAGRAPHS = "list_filter(list_transform(string_split_regex({c}, '\\n{{2,}}|\\n---\\n'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: len(x) >= 40)"


@query("fns6_paragraphs", f"SELECT doc_id, len({_PARAGRAPHS.format(c='text')}) AS n, list_sum(list_transform({_PARAGRAPHS.format(c='text')}, lambda x: len(x)))::BIGINT AS chars FROM documents")
def fns6_paragraphs(spark, d):
    parts = table(spark, d, "documents").select("doc_id", text.paragraphs(F.col("text")).alias("p"))
    chars = F.when(F.size("p") > 0, F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + F.length(x)))
    return parts.select("doc_id", F.size("p").cast("long").alias("n"), chars.alias("chars"))


@query("fns7_sentences")
def fns7_sentences(spark, d):
    """Sentences need lookarounds, which the SQL engine's regular expressions lack; tests hold the rule."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("at", "sentence"))


@query("fns8_term_density", """
SELECT doc_id, round(len(list_filter(w, lambda x: list_contains(['the', 'than', 'der', 'les', 'que'], x))) / sqrt(greatest(len(w), 1)), 9) AS density
FROM (SELECT doc_id, string_split_regex(lower(text), '[^\\p{L}\\p{N}]+') AS w FROM documents)""")
def fns8_term_density(spark, d):
    terms = F.array(*map(F.lit, ("the", "than", "der", "les", "que")))
    return table(spark, d, "documents").select("doc_id", F.round(text.density(F.col("text"), terms), 9).alias("density"))




@query("agg16_newest_version", f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Lib 1.' || (doc_id + 1) || '.0' END AS newest FROM documents")
def agg16_newest_version(spark, d):
    shown = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Lib 1."), F.col("doc_id").cast("string"), F.lit(".2 and Lib 1."), (F.col("doc_id") + 1).cast("string"))).otherwise("no version")
    newest = text.newest_version(shown)
    label = F.concat(newest["name"], F.lit(" "), newest["major"].cast("string"), F.lit("."), newest["minor"].cast("string"), F.lit("."), newest["patch"].cast("string"))
    return table(spark, d, "documents").select("doc_id", label.alias("newest"))


@query("fns12_version_hints")
def fns12_version_hints(spark, d):
    return table(spark, d, "documents").select("doc_id", text.newest_version(F.col("text")).alias("v")).select("doc_id", "v.name", "v.major", "v.minor", "v.patch")


@query("fns14_rewritten_query")
def fns14_rewritten_query(spark, d):
    return table(spark, d, "benchmark").select("item_id", text.rewrite_query(F.concat(F.lit("how to "), F.col("text"))).alias("rewritten"))


@query("fns15_expanded_queries")
def fns15_expanded_queries(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.posexplode(text.expand_query(F.concat(F.lit("best "), F.col("text")), 2)).alias("variant", "query"))


@query("fns16_site_stripped", "SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS query, 'docs.example.org' AS site FROM benchmark")
def fns16_site_stripped(spark, d):
    asked = F.concat(F.col("text"), F.lit(" site:docs.example.org"))
    return table(spark, d, "benchmark").select("item_id", text.strip_site(asked).alias("query"), text.site_of(asked).alias("site"))


@query("flt9_site_operator", "SELECT item_id, 'a.test' AS site, text AS query FROM benchmark")
def flt9_site_operator(spark, d):
    asked = F.concat(F.col("text"), F.lit(" SITE:a.test "))
    return table(spark, d, "benchmark").select("item_id", text.site_of(asked).alias("site"), text.without_trailing_site(asked).alias("query"))


_PLAIN = "text"
for _pattern, _by, _flags in ((r"\[([^\]]+)\]\(([^)]+)\)", r"\1", "g"), (r"\*\*([^*]+)\*\*", r"\1", "g"), ("__([^_]+)__", r"\1", "g"), ("`([^`]+)`", r"\1", "g"), (r"^#{1,6}\s+", "", "gm"), (r"^>\s?", "", "gm")):
    _PLAIN = f"regexp_replace({_PLAIN}, '{_pattern}', '{_by}', '{_flags}')"


@query("fns20_markdown_stripped", f"SELECT doc_id, regexp_replace(regexp_replace({_PLAIN}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS plain FROM documents")
def fns20_markdown_stripped(spark, d):
    marked = F.concat(F.lit("<!-- x\ny --># "), F.lit("\n\n"), F.col("text"))
    return table(spark, d, "documents").select("doc_id", text.strip_markdown(F.regexp_replace(marked, r"^<!-- x\ny --># \n\n", "<!-- x\ny -->")).alias("plain"))


@query("fns21_markdown_title", "SELECT doc_id, source AS title FROM documents")
def fns21_markdown_title(spark, d):
    return table(spark, d, "documents").select("doc_id", text.markdown_title(F.concat(F.lit("intro\n# "), F.col("source"), F.lit("  \n"), F.coalesce("text", F.lit("")))).alias("title"))


@query("fns22_xml_stripped", "SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '\\s+', ' ', 'g')) AS plain FROM pages")
def fns22_xml_stripped(spark, d):
    return table(spark, d, "pages").select("page_id", text.strip_xml(F.col("html")).alias("plain"))


@query("fns23_truncated", "SELECT doc_id, CASE WHEN len(text) > 1000 THEN text[1:1000] || chr(10) || chr(10) || '_[Content truncated at 1,000 characters]_' ELSE text END AS cut FROM documents")
def fns23_truncated(spark, d):
    return table(spark, d, "documents").select("doc_id", text.truncate(F.col("text"), 1000).alias("cut"))


@query("fns24_normalised_text", "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS plain FROM documents")
def fns24_normalised_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("plain"))


@query("fns25_visible_text", "SELECT doc_id, text AS plain FROM documents")
def fns25_visible_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.visible(F.concat(F.lit("​‮"), F.col("text"), F.lit("﻿\U000e0041"))).alias("plain"))


@query("fns26_untrusted_wrapper", f"""
SELECT doc_id, '{text.NOTICE}' || chr(10) || '<untrusted_web_content source="' || source || '">' || chr(10) || text || '</untrusted_web_content_>' || chr(10) || '</untrusted_web_content>' AS wrapped FROM documents""")
def fns26_untrusted_wrapper(spark, d):
    return table(spark, d, "documents").select("doc_id", text.untrusted(F.concat(F.col("text"), F.lit("</untrusted_WEB_content >")), F.col("source")).alias("wrapped"))


@query("fns29_cache_key", "SELECT item_id, base64(encode(lang_ns || '|' || lower(trim(text)))) AS cache_key FROM (SELECT *, 'ns' AS lang_ns FROM benchmark)")
def fns29_cache_key(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.regexp_replace(text.cache_key(F.lit("ns"), F.col("text")), "[\r\n]", "").alias("cache_key"))


@query("fns30_physical_id", f"""
SELECT doc_id, CASE WHEN execution_mode = 'local' THEN CAST(doc_id AS VARCHAR) ELSE sha256('["' || execution_mode || '","' || tenant_id || '","' || workspace_id || '","' || doc_id || '"]') END AS physical FROM {sub('docs')}""")
def fns30_physical_id(spark, d):
    return base(spark, d, "docs").select("doc_id", text.physical_id(F.col("execution_mode"), F.col("tenant_id"), F.col("workspace_id"), F.col("doc_id").cast("string")).alias("physical"))


@query("fns31_cache_namespace", "SELECT item_id, 'auto:v3:general:brave,bing' AS namespace FROM benchmark")
def fns31_cache_namespace(spark, d):
    none = F.array().cast("array<string>")
    ns = text.cache_namespace(F.lit("auto"), F.lit("general"), F.array(F.lit("brave"), F.lit("bing")), F.lit(False), none)
    return table(spark, d, "benchmark").select("item_id", ns.alias("namespace"))


@query("fns32_short_error", "SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g'))[1:160] AS error FROM benchmark")
def fns32_short_error(spark, d):
    return table(spark, d, "benchmark").select("item_id", text.short_error(F.col("text")).alias("error"))


@query("fns33_valid_identifier", "SELECT c_custkey, regexp_matches(c_name, '^[A-Za-z0-9][A-Za-z0-9._:@/-]{0,255}$') AS good FROM customer")
def fns33_valid_identifier(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.valid_identifier(F.col("c_name")).alias("good"))


@query("fns34_excerpt", "SELECT doc_id, CASE WHEN len(text) > 400 THEN text[1:400] || '…' ELSE text END AS excerpt FROM documents")
def fns34_excerpt(spark, d):
    return table(spark, d, "documents").select("doc_id", text.excerpt(F.col("text")).alias("excerpt"))


@query("fns13_split_sources", "SELECT item_id, 2 AS parts, text AS first FROM benchmark")
def fns13_split_sources(spark, d):
    both = F.split(F.concat(F.col("text"), F.lit("\n\n---\n\n"), F.lit("second")), r"\n\n---\n\n")
    return table(spark, d, "benchmark").select("item_id", F.size(both).alias("parts"), both[0].alias("first"))


@query("fnd1_publish_date", """
SELECT doc_id, printf('%04d-%02d-%02d', 2000 + doc_id % 25, 1 + doc_id % 12, 1 + doc_id % 28) AS iso, printf('%04d-03-%02d', 2000 + doc_id % 25, 1 + doc_id % 28) AS named, printf('%04d-03-%02d', 2000 + doc_id % 25, 1 + doc_id % 28) AS day_first FROM documents""")
def fnd1_publish_date(spark, d):
    today, i = F.lit("2025-06-15").cast("date"), F.col("doc_id")
    year, day = (i % 25 + 2000).cast("string"), (i % 28 + 1).cast("string")
    iso = F.concat_ws("-", year, F.lpad((i % 12 + 1).cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    shown = lambda *parts: dates.publish_date(F.concat_ws(" ", F.lit("Updated"), *parts, F.lit("by us")), today)
    return table(spark, d, "documents").select("doc_id", shown(iso).alias("iso"), shown(F.lit("Mar"), F.concat(day, F.lit(",")), year).alias("named"), shown(day, F.lit("March"), year).alias("day_first"))


@query("fnd1_relative_date", "SELECT doc_id, strftime(DATE '2025-06-15' - CAST(doc_id % 60 AS INTEGER), '%Y-%m-%d') AS days, strftime(DATE '2025-06-15' - to_months(CAST(doc_id % 60 AS INTEGER)), '%Y-%m-%d') AS months FROM documents")
def fnd1_relative_date(spark, d):
    today, n = F.lit("2025-06-15").cast("date"), (F.col("doc_id") % 60).cast("string")
    shown = lambda unit: dates.publish_date(F.concat_ws(" ", F.lit("posted"), n, F.lit(unit), F.lit("ago")), today)
    return table(spark, d, "documents").select("doc_id", shown("days").alias("days"), shown("months").alias("months"))


@query("flt5_date_range", "SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1995-01-01' AND '1996-12-31'")
def flt5_date_range(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, d, "orders").filter(dates.within(day, "1995-01-01", "1996-12-31", keep_undated=False)).select("o_orderkey")


@query("fnd2_normalised_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS pdf, strftime(o_orderdate, '%Y-01-01') AS pdf_year, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders")
def fnd2_normalised_date(spark, d):
    at = F.col("o_orderdate")
    pdf, year = F.concat(F.lit("D:"), F.date_format(at, "yyyyMMdd'103000'")), F.concat(F.lit("D:"), F.date_format(at, "yyyy"))
    return table(spark, d, "orders").select("o_orderkey", dates.normalize_published(pdf).alias("pdf"), dates.normalize_published(year).alias("pdf_year"), dates.normalize_published(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).alias("iso"))


@query("fnd3_freshness", "SELECT o_orderkey, (1998 - year(o_orderdate)) * 12 + 8 - month(o_orderdate) > 24 AS stale FROM orders")
def fnd3_freshness(spark, d):
    return table(spark, d, "orders").select("o_orderkey", dates.stale(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("1998-08-02").cast("date")).alias("stale"))


@query("fnd4_iso_timestamp", f"SELECT doc_id, strftime(make_timestamp(ts * 1000), '%Y-%m-%dT%H:%M:%S.000Z') AS at FROM {sub('docs')}")
def fnd4_iso_timestamp(spark, d):
    return base(spark, d, "docs").select("doc_id", dates.iso_timestamp(F.col("ts")).alias("at"))


_ASKED = "CASE event_id % 6 WHEN 0 THEN 'latest news about ' || event_type WHEN 1 THEN 'buy ' || event_type || ' today' WHEN 2 THEN 'redis config for ' || event_type WHEN 3 THEN event_type || ' near me' WHEN 4 THEN 'www.' || event_type || '.com' ELSE 'plain ' || event_type END"


def _asked():
    i, e = F.col("event_id") % 6, F.col("event_type")
    return (
        F.when(i == 0, F.concat(F.lit("latest news about "), e)).when(i == 1, F.concat(F.lit("buy "), e, F.lit(" today"))).when(i == 2, F.concat(F.lit("redis config for "), e))
        .when(i == 3, F.concat(e, F.lit(" near me"))).when(i == 4, F.concat(F.lit("www."), e, F.lit(".com"))).otherwise(F.concat(F.lit("plain "), e))
    )


_INTENT = "CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 6 = 5 THEN 'shopping' END ELSE CASE event_id % 6 WHEN 0 THEN 'news' WHEN 2 THEN 'technical' WHEN 3 THEN 'local' WHEN 4 THEN 'navigational' END END"


@query("fnc1_heuristic_intent", f"SELECT event_id, {_INTENT} AS intent FROM events")
def fnc1_heuristic_intent(spark, d):
    return table(spark, d, "events").select("event_id", routing.heuristic_intent(_asked()).alias("intent"))


@query("fnc2_intent_or_general", f"SELECT event_id, coalesce({_INTENT}, 'general') AS intent FROM events")
def fnc2_intent_or_general(spark, d):
    return table(spark, d, "events").select("event_id", routing.intent(_asked()).alias("intent"))


@query("fnc3_search_plan", f"""
SELECT event_id, CASE WHEN i IN ('news', 'technical', 'local', 'shopping') THEN 'aggregate' ELSE 'fallback' END AS strategy,
  CASE i WHEN 'technical' THEN ['brave', 'duckduckgo'] WHEN 'news' THEN ['duckduckgo', 'brave', 'bing'] WHEN 'local' THEN ['duckduckgo', 'brave'] WHEN 'shopping' THEN ['duckduckgo', 'brave'] WHEN 'navigational' THEN ['duckduckgo', 'brave', 'bing', 'marginalia'] ELSE ['duckduckgo', 'marginalia', 'bing', 'brave'] END AS primary_names,
  CASE i WHEN 'technical' THEN ['marginalia', 'bing'] WHEN 'news' THEN ['marginalia'] WHEN 'local' THEN ['marginalia', 'bing'] WHEN 'shopping' THEN ['marginalia', 'bing'] ELSE [] END AS fallback_names
FROM (SELECT event_id, coalesce({_INTENT}, 'general') AS i FROM events)""")
def fnc3_search_plan(spark, d):
    configured = F.array(*map(F.lit, ("duckduckgo", "marginalia", "bing", "brave")))
    plan = routing.plan(routing.intent(_asked()), configured)
    return table(spark, d, "events").select("event_id", plan.alias("p")).select("event_id", "p.strategy", F.col("p.primary").alias("primary_names"), F.col("p.fallback").alias("fallback_names"))


@query("flt15_configured_sources", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ['brave', 'bing'] ELSE ['duckduckgo'] END AS names FROM events")
def flt15_configured_sources(spark, d):
    setting = F.when(F.col("event_id") % 2 == 0, " Brave,bing,exa,unknown").otherwise("exa,none")
    names = routing.configured_sources(setting, ["duckduckgo", "bing", "brave", "exa"], ["exa", "tavily"], [])
    return table(spark, d, "events").select("event_id", names.alias("names"))


@query("fnc4_content_category", """
SELECT page_id, CASE WHEN regexp_matches(lower(url || ' Daily News'), '(^|[^a-z0-9_])(docs|wiki|tutorial|learn|documentation|guide|stackoverflow|api)($|[^a-z0-9_])') THEN 'docs' ELSE 'news' END AS category FROM pages""")
def fnc4_content_category(spark, d):
    return table(spark, d, "pages").select("page_id", routing.category(F.col("url"), F.lit("Daily News")).alias("category"))


@query("fnc5_time_to_live", f"""
SELECT event_id, CASE i WHEN 'news' THEN 900000 WHEN 'technical' THEN 86400000 WHEN 'navigational' THEN 86400000 ELSE 3600000 END AS search_ttl,
  CASE i WHEN 'news' THEN 3600000 WHEN 'technical' THEN 2592000000 ELSE 604800000 END AS content_ttl FROM (SELECT event_id, coalesce({_INTENT}, 'general') AS i FROM events)""")
def fnc5_time_to_live(spark, d):
    kind = routing.intent(_asked())
    return table(spark, d, "events").select("event_id", routing.search_ttl(kind).alias("search_ttl"), routing.content_ttl(routing.category_of_intent(kind)).alias("content_ttl"))


@query("fnc6_market", "SELECT doc_id, CASE lang WHEN 'fr' THEN 'fr-FR' WHEN 'de' THEN 'de-DE' WHEN 'es' THEN 'es-ES' ELSE 'en-US' END AS market FROM documents")
def fnc6_market(spark, d):
    code = F.element_at(F.create_map(*map(F.lit, ("fr", "fra_Latn", "de", "deu_Latn", "es", "spa_Latn", "en", "eng_Latn"))), F.col("lang"))
    return table(spark, d, "documents").select("doc_id", routing.market(F.col("text"), code).alias("market"))


@query("fnc6_inferred_market", "SELECT doc_id, CASE WHEN regexp_matches(text, '[çğıöşüÇĞİÖŞÜ]') OR regexp_matches(lower(text), '(^|[^a-z0-9_])(kur|gram|ons|fiyat|haber|altın)($|[^a-z0-9_])') THEN 'tr-TR' ELSE 'en-US' END AS market FROM documents")
def fnc6_inferred_market(spark, d):
    return table(spark, d, "documents").select("doc_id", routing.market(F.col("text")).alias("market"))


@query("fnc7_cross_search", f"SELECT doc_id, lang <> 'en' AS cross_search FROM documents")
def fnc7_cross_search(spark, d):
    return table(spark, d, "documents").select("doc_id", routing.cross_search(F.lit("general"), F.col("lang")).alias("cross_search"))


@query("fns1_chunks")
def fns1_chunks(spark, d):
    """Greedy packing is not SQL; tests hold it against its invariants and given pairs."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(chunks.chunks(F.col("text"))).alias("chunk_index", "text"))


@query("fns28_entities")
def fns28_entities(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(entities.entities(F.col("text"))).alias("e")).select("doc_id", "e.name", "e.n")


@query("src9_html_to_markdown")
def src9_html_to_markdown(spark, d):
    return table(spark, d, "pages").select("page_id", html.markdown_of(F.col("html")).alias("m")).select("page_id", "m.title", "m.text")


@query("src10_main_article")
def src10_main_article(spark, d):
    return table(spark, d, "pages").select("page_id", html.article_of(F.col("html")).alias("a")).select("page_id", "a.title", "a.content", "a.published_at")


@query("flt14_hidden_elements")
def flt14_hidden_elements(spark, d):
    return table(spark, d, "pages").select("page_id", html.visible_text(F.col("html")).alias("text"))


@query("src17_feed_items", """
SELECT doc_id, source AS title, 'https://' || source || '.test/' || doc_id AS url FROM documents""")
def src17_feed_items(spark, d):
    feed = F.concat(F.lit("<rss><channel><item><title><![CDATA["), F.col("source"), F.lit("]]></title><link>https://"), F.col("source"), F.lit(".test/"), F.col("doc_id").cast("string"), F.lit("</link></item></channel></rss>"))
    return table(spark, d, "documents").select("doc_id", F.explode(html.feed_items(feed)).alias("i")).select("doc_id", "i.title", "i.url")


@query("src20_result_pages", "SELECT page_id, 'Page ' || page_id AS title, url, 'About ' || page_id AS snippet FROM pages")
def src20_result_pages(spark, d):
    i = F.col("page_id").cast("string")
    page = F.concat(F.lit('<ol><li class="b_algo"><h2><a href="'), F.col("url"), F.lit('">Page  '), i, F.lit('</a></h2><div class="b_caption"><p>About '), i, F.lit("</p></div></li></ol>"))
    return table(spark, d, "pages").select("page_id", F.explode(html.result_items("bing", page)).alias("r")).select("page_id", "r.title", "r.url", "r.snippet")


_LATIN = "regexp_matches(text, '^[\\x00-\\xFF]*$')"


@query("src18_charset_decode", f"SELECT doc_id, CASE WHEN {_LATIN} AND doc_id % 3 = 1 THEN '<meta charset=\"ISO-8859-1\">' ELSE '' END || text AS decoded FROM documents")
def src18_charset_decode(spark, d):
    """Texts as bytes: of those that Latin 1 can hold every third in it as the page declares, every third as the type names;
    all others in UTF-8."""
    latin, i = F.col("text").rlike(r"^[\x00-\xFF]*$"), F.col("doc_id") % 3
    page = F.when(latin & (i == 1), F.concat(F.lit('<meta charset="ISO-8859-1">'), "text")).otherwise(F.col("text"))
    narrow = latin & (i > 0)
    raw = F.when(narrow, F.encode(F.when(narrow, page), "iso-8859-1")).otherwise(F.encode(page, "utf-8"))
    kind = F.when(latin & (i == 2), "text/html; charset=latin1").otherwise("text/html")
    return table(spark, d, "documents").select("doc_id", fetching.decoded(raw, kind).alias("decoded"))


@query("src14_reader_pages", "SELECT doc_id, source AS title, text AS content FROM documents WHERE len(text) >= 50")
def src14_reader_pages(spark, d):
    answer = F.concat(F.lit("Title: "), F.col("source"), F.lit("\nURL Source: x\nMarkdown Content:\n"), F.col("text"))
    return table(spark, d, "documents").select("doc_id", fetching.reader_page(answer).alias("p")).filter("p IS NOT NULL").select("doc_id", "p.title", "p.content")


@query("src4_format_sniff", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'archive' WHEN 2 THEN 'html' ELSE 'text' END AS format FROM documents")
def src4_format_sniff(spark, d):
    from larkspan.sources.documents import sniff

    i = F.col("doc_id") % 4
    head = F.when(i == 0, F.lit("%PDF-1.7")).when(i == 1, F.lit("PK\x03\x04")).otherwise("plain").cast("binary")
    name = F.when(i == 2, "a.html").otherwise("a.txt")
    return table(spark, d, "documents").select("doc_id", sniff(head, name, F.lit("")).alias("format"))
