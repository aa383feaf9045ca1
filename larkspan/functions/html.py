"""HTML: a small tree, hidden elements, Markdown, main article, feeds and result pages."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import Column
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES = {"p": ("p",), "li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
_BLOCKS = frozenset("address article aside blockquote body dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td th thead tr ul".split())
#: Lengths that make text invisible; fixed values.
_NO_SIZE = ("0", "0px", "0em", "0rem", "0%")


def hides(style: str) -> bool:
    """Whether an inline style hides its element: by display, visibility, opacity or size of the font."""
    for declaration in style.lower().split(";"):
        name, _, value = (x.strip() for x in declaration.partition(":"))
        if (name, value[:4]) == ("display", "none") or (name, value[:6]) == ("visibility", "hidden"):
            return True
        if name == "font-size" and value in _NO_SIZE:
            return True
        if name == "opacity" and (value == "0" or (value.startswith("0.") and len(value) > 2 and not value[2:].strip("0"))):
            return True
    return False


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs or {}, parent, []

    def walk(self):
        for child in self.children:
            if isinstance(child, Node):
                yield child
                yield from child.walk()

    def all(self, tag: str | None = None, cls: str | None = None):
        return [n for n in self.walk() if (tag is None or n.tag == tag) and (cls is None or cls in (n.attrs.get("class") or "").split())]

    def first(self, tag: str | None = None, cls: str | None = None):
        return next((n for n in self.walk() if (tag is None or n.tag == tag) and (cls is None or cls in (n.attrs.get("class") or "").split())), None)

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def drop(self, which) -> None:
        kept = []
        for child in self.children:
            if isinstance(child, Node):
                if which(child):
                    continue
                child.drop(which)
            kept.append(child)
        self.children = kept


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("root")

    def handle_starttag(self, tag, attrs):
        while self.at.tag in _CLOSES.get(tag, ()):
            self.at = self.at.parent
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def clean(text: str | None) -> str:
    return " ".join((text or "").split())


def hidden(node: Node) -> bool:
    """Elements that a reader can't see, as far as their own attributes tell."""
    return node.tag == "template" or "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true" or hides(node.attrs.get("style") or "")


def markdown(node: Node) -> str:
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", _markdown(node, ""))).strip()


def _markdown(node: Node, bullet: str) -> str:
    parts = []
    number = 0
    for child in node.children:
        if isinstance(child, str):
            parts.append(re.sub(r"\s+", " ", child))
            continue
        tag = child.tag
        if tag == "li":
            number += 1
        inner = _markdown(child, "*   " if tag == "ul" else "1." if tag == "ol" else bullet)
        body = inner.strip()
        if tag in ("script", "style", "noscript", "template", "title", "head"):
            continue
        if re.fullmatch("h[1-6]", tag):
            parts.append(f"\n\n{'#' * int(tag[1])} {clean(body)}\n\n" if body else "")
        elif tag in ("b", "strong"):
            parts.append(f"**{body}**" if body else "")
        elif tag in ("i", "em"):
            parts.append(f"_{body}_" if body else "")
        elif tag == "a":
            parts.append(f"[{body}]({child.attrs.get('href')})" if body and child.attrs.get("href") else inner)
        elif tag == "img":
            parts.append(f"![{child.attrs.get('alt') or ''}]({child.attrs.get('src')})" if child.attrs.get("src") else "")
        elif tag == "code" and node.tag != "pre":
            parts.append(f"`{child.text()}`" if body else "")
        elif tag == "pre":
            parts.append(f"\n\n```\n{child.text().strip(chr(10))}\n```\n\n")
        elif tag == "li":
            mark = f"{number}.  " if bullet == "1." else "*   "
            parts.append(f"\n{mark}{body}\n")
        elif tag == "blockquote":
            parts.append("\n\n" + "\n".join(f"> {line}" for line in body.splitlines()) + "\n\n")
        elif tag == "br":
            parts.append("  \n")
        elif tag == "hr":
            parts.append("\n\n* * *\n\n")
        elif tag in _BLOCKS:
            parts.append(f"\n\n{body}\n\n" if body else "")
        else:
            parts.append(inner)
    return "".join(parts)


def to_markdown(html: str | None) -> dict:
    """Title and Markdown of a page, scripts and styles apart."""
    root = parse(html)
    title = root.first("title")
    body = root.first("body") or root
    return {"title": clean(title.text()) if title else "", "text": markdown(body)}


def article(html: str | None, least: int = 200, default: str = "Untitled") -> dict | None:
    """The main article of a page as title, Markdown and date; None where it is no longer than `least` characters.

    The container wins whose paragraphs have most text, less what is in links; navigation and the like do not count.
    """
    root = parse(html)
    root.drop(lambda n: hidden(n) or n.tag in ("script", "style", "noscript", "nav", "footer", "aside", "form"))
    scores: dict[int, float] = {}
    nodes: dict[int, Node] = {}
    for p in root.all("p"):
        size = len(clean(p.text())) - sum(len(clean(a.text())) for a in p.all("a"))
        node, share = p.parent, 1.0
        while node is not None and share > 0.2:
            scores[id(node)] = scores.get(id(node), 0) + size * share
            nodes[id(node)] = node
            node, share = node.parent, share / 2
    best = nodes[max(scores, key=scores.get)] if scores else root.first("article") or root.first("main")
    text = markdown(best) if best is not None else ""
    if len(text) <= least:
        return None
    title, heading = root.first("title"), root.first("h1")
    name = clean(title.text()) if title else clean(heading.text()) if heading else ""
    return {"title": name or default, "content": text, "published_at": published(root)}


def published(root: Node) -> str | None:
    for node in root.all("meta"):
        if (node.attrs.get("property") or node.attrs.get("name") or "") in ("article:published_time", "date", "pubdate", "publish-date"):
            found = re.match(r"\d{4}-\d{2}-\d{2}", node.attrs.get("content") or "")
            if found:
                return found[0]
    time = root.first("time")
    found = re.match(r"\d{4}-\d{2}-\d{2}", (time.attrs.get("datetime") or "") if time else "")
    return found[0] if found else None


def _xml_text(xml: str) -> str:
    xml = re.sub(r"<[^>]+>", " ", re.sub(r"<!\[CDATA\[(.*?)\]\]>", r"\1", xml, flags=re.DOTALL))
    for entity, by in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        xml = xml.replace(entity, by)
    return clean(xml)


def feed(xml: str | None, most: int = 25) -> list[dict]:
    """Items of an RSS or Atom feed that have a title or a link: title, url and snippet."""
    blocks = re.findall(r"<item.*?</item>", xml or "", re.DOTALL | re.IGNORECASE) or re.findall(r"<entry.*?</entry>", xml or "", re.DOTALL | re.IGNORECASE)
    out = []
    for block in blocks[:most]:
        inner = lambda *tags: next((m[1] for t in tags if (m := re.search(rf"<{t}[^>]*>(.*?)</{t}>", block, re.DOTALL | re.IGNORECASE))), "")  # noqa: B023, E731
        link = re.search(r"<link[^>]*href=[\"']([^\"']+)[\"']", block, re.IGNORECASE) or re.search(r"<link>([^<]+)</link>", block, re.IGNORECASE)
        item = {"title": _xml_text(inner("title"))[:140], "url": _xml_text(link[1]) if link else "", "snippet": _xml_text(inner("description", "summary"))[:240]}
        if item["title"] or item["url"]:
            out.append(item)
    return out


#: Where each engine's result pages have a result, its link and its snippet; fixed values. cut: ten come before the filter.
ENGINES = {
    "duckduckgo": {"base": "https://duckduckgo.com", "cut": False},
    "bing": {"base": "https://www.bing.com", "cut": True},
    "brave": {"base": "https://search.brave.com", "cut": True},
    "google": {"base": "https://www.google.com", "cut": True},
    "yahoo": {"base": "https://search.yahoo.com", "cut": False, "own": "yahoo.com"},
    "marginalia": {"base": "https://marginalia-search.com", "cut": False, "own": "marginalia-search.com"},
}


def _up(node: Node | None, tag: str, cls: str | None = None) -> Node | None:
    while node is not None and not (node.tag == tag and (cls is None or cls in (node.attrs.get("class") or "").split())):
        node = node.parent
    return node


def _after(node: Node) -> Node | None:
    siblings = [c for c in node.parent.children if isinstance(c, Node)]
    at = siblings.index(node) + 1
    return siblings[at] if at < len(siblings) else None


def _candidates(engine: str, root: Node):
    """(link, title, snippet) of each result."""
    shown = lambda n: clean(n.text()) if n is not None else ""
    if engine == "duckduckgo":
        for a in root.all("a", "result-link"):
            row = _up(a, "tr")
            after = _after(row) if row is not None and row.parent is not None else None
            yield a.attrs.get("href"), shown(a), shown((after.first("td", "result-snippet") if after else None) or (row.first("td", "result-snippet") if row else None))
    elif engine == "bing":
        for box in root.all(cls="b_algo"):
            head, caption = box.first("h2"), box.first(cls="b_caption")
            a = head.first("a") if head else None
            yield (a.attrs.get("href") if a else ""), shown(a), shown(caption.first("p") if caption else None)
    elif engine == "brave":
        snippets = [shown(n) for n in root.all("div") if {"content", "inline-qa-answer"} & set((n.attrs.get("class") or "").split())]
        for i, a in enumerate(root.all("a", "l1")):
            yield a.attrs.get("href"), shown(a), snippets[i] if i < len(snippets) else ""
    elif engine == "google":
        for a in root.all("a"):
            if a.first("h3"):
                box = a.parent.parent if a.parent is not None else None
                note = next((n for n in (box.walk() if box is not None else ()) if "-webkit-line-clamp" in (n.attrs.get("style") or "") or "aCOpRe" in (n.attrs.get("class") or "")), None)
                yield a.attrs.get("href"), shown(a), shown(note)
    elif engine == "yahoo":
        for box in root.all(cls="algo"):
            head = box.first(cls="compTitle")
            a = head.first("a") if head else None
            yield (a.attrs.get("href") if a else ""), shown(head.first("h3") if head else None), shown(box.first(cls="compText"))
    else:
        main = root.first("main")
        for head in main.all("h2") if main else ():
            a = head.first("a")
            if a is not None and a.attrs.get("href"):
                card = _up(a, "div", "border")
                yield a.attrs["href"], shown(a), shown(card.first("p", "mt-2") if card else None)


def results(engine: str, html: str | None) -> list[dict]:
    """Up to ten results of a page: title, url as it stands there made absolute, snippet. A result has a title and a url;
    own pages of some engines do not count; engines differ in whether ten are taken before or after that."""
    how = ENGINES[engine]
    out = []
    for link, title, snippet in _candidates(engine, parse(html)):
        out.append({"title": title, "url": urljoin(how["base"], link or "") if link else "", "snippet": snippet})
    if how["cut"]:
        out = out[:10]
    own = how.get("own")
    good = [r for r in out if r["title"] and re.match(r"[A-Za-z][\w+.-]*:", r["url"]) and not (own and re.match(rf"[a-z]+://([^/]*\.)?{re.escape(own)}(/|$)", r["url"]) and "/RU=" not in r["url"])]
    return good[:10]


ARTICLE = "struct<title:string,content:string,published_at:string>"
PAGE = "struct<title:string,text:string>"
ITEMS = "array<struct<title:string,url:string,snippet:string>>"


def article_of(c: Column) -> Column:
    return F.udf(article, ARTICLE, useArrow=True)(c)


def markdown_of(c: Column) -> Column:
    return F.udf(to_markdown, PAGE, useArrow=True)(c)


def visible_text(c: Column) -> Column:
    """Text of a page without hidden elements."""

    def run(html):
        root = parse(html)
        root.drop(lambda n: hidden(n) or n.tag in ("script", "style"))
        return clean(root.text())

    return F.udf(run, "string", useArrow=True)(c)


def feed_items(c: Column) -> Column:
    return F.udf(feed, ITEMS, useArrow=True)(c)


def result_items(engine: str, c: Column) -> Column:
    return F.udf(lambda html: results(engine, html), ITEMS, useArrow=True)(c)


def decode_entities(text: str) -> str:
    return unescape(text)
