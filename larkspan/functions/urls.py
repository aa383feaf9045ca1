"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track; a fixed value.
TRACKING = r"(?i)^(utm_[a-z0-9_]+|fbclid|gclid|dclid|msclkid|mc_cid|mc_eid)$"


def part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def is_url(url: Column) -> Column:
    return url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & (part(url, "PROTOCOL").isNotNull())


def host(url: Column) -> Column:
    return F.lower(part(url, "HOST"))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def normalize_domain(domain: Column) -> Column:
    """Host of a domain filter without www; null for blank ones."""
    low = F.lower(F.trim(domain))
    full = F.when(F.contains(low, F.lit("://")), low).otherwise(F.concat(F.lit("https://"), low))
    plain = F.regexp_replace(F.regexp_replace(low, r"^www\.", ""), "/.*$", "")
    return F.when(low == "", None).otherwise(F.coalesce(bare_host(full), plain))


def domain_matches(url: Column, domain: Column) -> Column:
    """Whether the url's host is the domain or under it; a null domain matches all, a url without host none."""
    wanted, own = normalize_domain(domain), bare_host(url)
    return F.when(wanted.isNull(), True).otherwise(F.coalesce((own == wanted) | own.endswith(F.concat(F.lit("."), wanted)), F.lit(False)))


def normalize(url: Column) -> Column:
    """One form for urls of the same page: no www, tracking parameters, fragments (but routes) or slashes at the end;
    parameters in stable order of their keys. What is not a url is trimmed."""
    fragment = F.coalesce(part(url, "REF"), F.lit(""))
    route = F.when(fragment.startswith("/") | fragment.startswith("!"), F.concat(F.lit("#"), fragment)).otherwise("")
    path = F.coalesce(part(url, "PATH"), F.lit(""))
    path = F.when(path.isin("/", ""), F.when(route == "", "").otherwise("/")).otherwise(F.regexp_replace(path, "/+$", ""))
    pairs = F.filter(F.split(F.coalesce(part(url, "QUERY"), F.lit("")), "&"), lambda p: p != "")
    keyed = F.transform(pairs, lambda p, i: F.struct(F.split(p, "=")[0].alias("key"), i.alias("at"), F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))).alias("pair")))
    kept = F.array_sort(F.filter(keyed, lambda p: ~p["key"].rlike(TRACKING)))
    query = F.array_join(F.transform(kept, lambda p: p["pair"]), "&")
    authority = F.coalesce(part(url, "AUTHORITY"), F.lit(""))
    scheme = F.lower(part(url, "PROTOCOL"))
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    usual = F.when(scheme == "https", "443").when(scheme == "http", "80").otherwise("")
    shown = F.when((port == "") | (port == usual), "").otherwise(F.concat(F.lit(":"), port))
    full = F.concat(scheme, F.lit("://"), bare_host(url), shown, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)), route)
    return F.coalesce(full, F.trim(url))


def absolute(url: Column, base: Column) -> Column:
    """Against the base's scheme and authority; other relative forms than root paths stay."""
    root = F.concat(part(base, "PROTOCOL"), F.lit("://"), part(base, "AUTHORITY"))
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).when(url.startswith("/"), F.concat(root, url)).otherwise(url)


def decode_duckduckgo(url: Column) -> Column:
    full = absolute(url, F.lit("https://duckduckgo.com"))
    target = F.try_url_decode(F.try_parse_url(full, F.lit("QUERY"), F.lit("uddg")))
    return F.when(F.coalesce(is_url(target), F.lit(False)), target).otherwise(full)


def decode_bing(url: Column) -> Column:
    code = F.try_parse_url(url, F.lit("QUERY"), F.lit("u"))
    body = F.translate(F.when(code.startswith("a1"), F.substring(code, 3, 1 << 20)).otherwise(code), "-_", "+/")
    padded = F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), F.lit("="))
    target = F.try_to_binary(padded, F.lit("base64")).cast("string")
    ours = (host(url) == "www.bing.com") & part(url, "PATH").startswith("/ck/")
    return F.when(F.coalesce(ours & is_url(target), F.lit(False)), target).otherwise(url)


def decode_yahoo(url: Column) -> Column:
    target = F.try_url_decode(F.nullif(F.regexp_extract(url, "/RU=([^/]+)/", 1), F.lit("")))
    return F.coalesce(target, url)


def title_from_url(url: Column) -> Column:
    parts = F.filter(F.split(F.coalesce(part(url, "PATH"), F.lit("")), "/"), lambda p: p != "")
    return F.when(~F.coalesce(is_url(url), F.lit(False)), "Untitled Page").when(F.size(parts) > 0, F.regexp_replace(F.element_at(parts, -1), "[-_]", " ")).otherwise(host(url))


def github_raw(url: Column) -> Column:
    """Raw-file candidates of a repository, blob or tree page; else an empty array."""
    none = F.array().cast("array<string>")
    parts = F.filter(F.split(F.coalesce(part(url, "PATH"), F.lit("")), "/"), lambda p: p != "")
    names = F.array(*map(F.lit, ("README.md", "readme.md", "Readme.md")))
    base = F.concat(F.lit("https://raw.githubusercontent.com/"), F.get(parts, F.lit(0)), F.lit("/"), F.get(parts, F.lit(1)), F.lit("/"))
    rest = F.array_join(F.slice(parts, 5, F.greatest(F.size(parts) - 4, F.lit(0))), "/")
    under = F.concat(base, F.get(parts, F.lit(3)), F.lit("/"), F.when(rest == "", "").otherwise(F.concat(rest, F.lit("/"))))
    repo = F.flatten(F.transform(F.array(F.lit("main"), F.lit("master")), lambda b: F.transform(names, lambda n: F.concat(base, b, F.lit("/"), n))))
    found = (
        F.when(host(url) == "raw.githubusercontent.com", F.array(url))
        .when(~host(url).isin("github.com", "www.github.com") | (F.size(parts) < 2), none)
        .when(F.size(parts) == 2, repo)
        .when((F.get(parts, F.lit(2)) == "blob") & (F.size(parts) >= 5), F.array(F.concat(base, F.get(parts, F.lit(3)), F.lit("/"), rest)))
        .when((F.get(parts, F.lit(2)) == "tree") & (F.size(parts) >= 4), F.transform(names, lambda n: F.concat(under, n)))
        .otherwise(none)
    )
    return F.coalesce(found, none)


def feed_candidates(url: Column) -> Column:
    """Places where the feed of a page may be, the page itself first; else an empty array."""
    path = F.lower(F.coalesce(part(url, "PATH"), F.lit("")))
    probe = path.endswith(".xml") | F.contains(path, F.lit("/feed")) | F.contains(path, F.lit("/rss")) | path.rlike(r"/(blog|news|articles|posts?)/?$")
    root = F.concat(part(url, "PROTOCOL"), F.lit("://"), part(url, "AUTHORITY"))
    paths = F.array(*map(F.lit, ("/feed.xml", "/rss.xml", "/atom.xml", "/feed/", "/rss/", "/index.xml")))
    return F.when(F.coalesce(probe & is_url(url), F.lit(False)), F.array_distinct(F.concat(F.array(url), F.transform(paths, lambda p: F.concat(root, p))))).otherwise(F.array().cast("array<string>"))


def public_address(url: Column) -> Column:
    """'ok', 'invalid_url', 'unsupported_protocol' or 'private_host', as far as the text of a url tells; names that only
    an address look-up could tell about are 'ok'."""
    name = F.lower(F.coalesce(part(url, "HOST"), F.lit("")))
    bare = F.regexp_replace(name, r"^\[|\]$", "")
    four = bare.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    octet = lambda i: F.coalesce(F.split(bare, r"\.")[i].try_cast("int"), F.lit(-1))
    a, b = F.when(four, octet(0)).otherwise(-1), F.when(four, octet(1)).otherwise(-1)
    private4 = a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127))
    six = F.contains(bare, F.lit(":"))
    private6 = six & (bare.startswith("fc") | bare.startswith("fd") | bare.startswith("fe80") | bare.isin("::1", "0:0:0:0:0:0:0:1") | bare.startswith("::ffff:7f") | bare.startswith("::ffff:127.") | bare.startswith("::ffff:10."))
    return (
        F.when(~F.coalesce(is_url(url), F.lit(False)), "invalid_url")
        .when(~F.lower(part(url, "PROTOCOL")).isin("http", "https"), "unsupported_protocol")
        .when(bare.isin("localhost", "localhost6", "") | private4 | private6, "private_host")
        .otherwise("ok")
    )
