"""Classification of queries and the plans that follow from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE = 60_000
HOUR = 60 * MINUTE
DAY = 24 * HOUR

#: How long content of a category is kept, and results of an intent; fixed values.
CONTENT_TTL = {"price": 15 * MINUTE, "news": HOUR, "blog": 5 * DAY, "docs": 30 * DAY, "technical": 30 * DAY, "social": 3 * DAY, "general": 7 * DAY}
SEARCH_TTL = {"news": 15 * MINUTE, "shopping": HOUR, "local": HOUR, "commercial": HOUR, "general": HOUR, "technical": DAY, "research": DAY, "navigational": DAY}

#: Patterns of each intent; fixed values. Word boundaries are those of ASCII words.
INTENTS = {
    "technical": [
        r"\b(typeerror|referenceerror|sqlstate|stack trace|http 5\d\d|eresolve)\b",
        r"\b(api|sdk|docs?|documentation|configuration|runtime|database|query|migration|queue|docker|kubernetes)\b.*\b(error|implement|configure|retry|debug|optimi[sz]e|best practices?)\b",
        r"\b(npm|composer|laravel|symfony|react|vue|next\.?js|nestjs|postgres(?:ql)?|mysql|redis|kafka)\b.*\b(error|config|configuration|implementation|retry|migration|query|worker)\b",
    ],
    "news": [r"\b(latest|today|breaking|news|announcement|announced)\b", r"\b(bugün|son dakika|haber(?:ler)?|duyuru)\b"],
    "shopping": [r"\b(buy|price|deal|discount|purchase|cheapest|in stock)\b", r"\b(satın al|fiyat|indirim|kampanya|stokta)\b"],
    "local": [r"\b(near me|nearby|closest|in my area)\b", r"\b(yakınımda|yakınımdaki|yakındaki|en yakın)\b"],
    "navigational": [
        r"https?://",
        r"\b[a-z0-9-]+\.(?:com|org|net|dev|io|ai)(?:/|\b)",
        r"\b(official site|official website|official docs|documentation page)\b",
        r"\b(resmi site|resmi web sitesi|dokümantasyon sayfası)\b",
    ],
    "commercial": [r"\b(vendor|vendors|competitor|competitors|enterprise product|company discovery|supplier)\b", r"\b(tedarikçi|rakip(?:ler)?|kurumsal ürün|şirket araştırması)\b"],
    "research": [r"\b(landscape|market share|adoption|survey|evidence|benchmark|industry analysis)\b", r"(?:pazar payı|benimsenme|araştırma|anket|kanıt|sektör analizi)"],
}

_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"

#: Routing profiles, version v3: strategy, preference and how many providers come first (0: all); fixed values.
PROFILE_VERSION = "v3"
DEPTH = ["searxng", "brave", "duckduckgo", "bing", "google"]
BREADTH = ["searxng", "duckduckgo", "brave", "bing", "google"]
NEWS = ["tavily", "duckduckgo", "searxng", "brave", "bing", "google"]
RESEARCH = ["exa", "tavily", "searxng", "duckduckgo", "brave", "bing", "google"]
PROFILES = {
    "technical": ("aggregate", DEPTH, 2),
    "research": ("aggregate", RESEARCH, 3),
    "news": ("aggregate", NEWS, 3),
    "commercial": ("aggregate", DEPTH, 3),
    "shopping": ("aggregate", BREADTH, 2),
    "local": ("aggregate", BREADTH, 2),
    "navigational": ("fallback", BREADTH, 0),
    "general": ("fallback", [], 0),
}

#: Words of each category of content; fixed values, tried in this order.
CATEGORIES = [
    ("docs", "docs|wiki|tutorial|learn|documentation|guide|stackoverflow|api"),
    ("news", "news|haber|breaking|daily|journal|gazete"),
    ("social", "reddit|forum|community|discord"),
    ("blog", r"blog|article|medium\.com|substack"),
]

#: Languages by the code of a detector, with the markets they mean; fixed values.
LOCALES = {"tur": "tr-TR", "eng": "en-US", "deu": "de-DE", "fra": "fr-FR", "spa": "es-ES", "ita": "it-IT", "por": "pt-PT", "nld": "nl-NL"}

_STRINGS = "array<string>"


def _lookup(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def heuristic_intent(query: Column) -> Column:
    """The intent that alone has a matching pattern; null where none or several have."""
    found = [F.when(reduce(lambda a, b: a | b, [query.rlike("(?i)" + p.replace(r"\b", _EDGE)) for p in patterns]), F.lit(name)) for name, patterns in INTENTS.items()]
    names = F.array_compact(F.array(*found))
    return F.when(F.size(names) == 1, names[0])


def intent(query: Column) -> Column:
    """The heuristic intent; general where a classifier would be asked and none is there."""
    return F.coalesce(heuristic_intent(query), F.lit("general"))


def plan(kind: Column, configured: Column) -> Column:
    """struct<strategy, primary, fallback, version>: preferred providers first, then the other configured ones."""
    own = F.array_distinct(configured)
    strategy = _lookup({k: v[0] for k, v in PROFILES.items()}, kind)
    preference = F.element_at(F.create_map(*[x for k, v in PROFILES.items() for x in (F.lit(k), F.array(*map(F.lit, v[1])).cast(_STRINGS))]), kind)
    target = _lookup({k: v[2] for k, v in PROFILES.items()}, kind)
    ordered = F.concat(F.array_intersect(preference, own), F.array_except(own, preference))
    primary = F.when(target == 0, ordered).otherwise(F.slice(ordered, F.lit(1), F.greatest(target, F.lit(1))))
    fallback = F.when(strategy == "aggregate", F.array_except(own, primary)).otherwise(F.array().cast(_STRINGS))
    return F.struct(strategy.alias("strategy"), primary.alias("primary"), fallback.alias("fallback"), F.lit(PROFILE_VERSION).alias("version"))


def configured_sources(setting: Column, known: list[str], with_key: list[str], keys: list[str]) -> Column:
    """Names of a comma list that are known, those that need a key only with one; duckduckgo where none is left."""
    names = F.filter(F.transform(F.split(F.lower(setting), ","), lambda n: F.trim(n)), lambda n: n.isin(*known))
    missing = [k for k in with_key if k not in keys]
    usable = F.filter(names, lambda n: ~n.isin(*missing)) if missing else names
    return F.when(F.size(usable) == 0, F.array(F.lit("duckduckgo"))).otherwise(F.array_distinct(usable))


def category(url: Column, title: Column) -> Column:
    text = F.lower(F.concat_ws(" ", url, title))
    out = F.lit("general")
    for name, words in reversed(CATEGORIES):
        out = F.when(text.rlike(f"{_EDGE}({words}){_EDGE}"), name).otherwise(out)
    return out


def category_of_intent(kind: Column) -> Column:
    return F.when(kind.isin("news", "technical"), kind).otherwise("general")


def content_ttl(kind: Column) -> Column:
    return F.coalesce(_lookup(CONTENT_TTL, kind), F.lit(CONTENT_TTL["general"])).cast("long")


def search_ttl(kind: Column) -> Column:
    return F.coalesce(_lookup(SEARCH_TTL, kind), F.lit(SEARCH_TTL["general"])).cast("long")


def market(query: Column, detected: Column | None = None) -> Column:
    """The market of a detected language, else Turkish by its letters and words, else English."""
    words = f"{_EDGE}(altın|fiyat|döviz|haber|bugün|gram|çeyrek|ons|kur){_EDGE}"
    guess = F.when(query.rlike("[çğıöşüÇĞİÖŞÜ]") | F.lower(query).rlike(words), "tr-TR").otherwise("en-US")
    return guess if detected is None else F.coalesce(_lookup(LOCALES, F.lower(F.split(detected, "_")[0])), guess)


def accept_language(name: Column) -> Column:
    language = F.substring(name, 1, 2)
    return F.when(name == "en-US", "en-US,en;q=0.9").otherwise(F.concat(name, F.lit(","), language, F.lit(";q=0.9,en;q=0.7")))


def cross_search(kind: Column, language: Column) -> Column:
    return kind.isin("technical", "general") & (language != "en")
