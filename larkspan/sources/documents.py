"""Documents as files: scan, format, extraction."""

from __future__ import annotations

import io
import os
import posixpath
import xml.etree.ElementTree as ET
import zipfile
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions.html import to_markdown
from larkspan.functions.text import normalize_text

MOST_BYTES, MOST_EXPANDED, MOST_CHARS = 25 << 20, 100 << 20, 2_000_000
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_DC = "{http://purl.org/dc/elements/1.1/}"


def allowed_dirs(setting: str | None, home: str | None = None) -> list[str]:
    """Folders of a comma list, with ~ for the home folder."""
    home = home or os.path.expanduser("~")
    return [os.path.abspath(home + p[1:] if p == "~" or p.startswith("~/") else p) for p in map(str.strip, (setting or "").split(",")) if p]


def scan(spark: SparkSession, folders: list[str], most: int = MOST_BYTES) -> DataFrame:
    """(path, content, length) of regular files under the folders, without hidden names on the way and not too large."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders)
    return files.filter((F.col("length") <= most) & ~F.col("path").rlike(r"/\.[^/]+")).select("path", "content", "length")


def sniff(content: Column, name: Column, kind: Column) -> Column:
    """'pdf', 'archive', 'html', 'text' or 'unsupported', by the first bytes, then by type and name."""
    head = F.substring(content, 1, 5).cast("binary")
    starts = lambda mark: F.substring(head, 1, len(mark)).cast("binary") == F.lit(mark)
    return (
        F.when(starts(b"%PDF-"), "pdf").when(starts(b"PK\x03\x04"), "archive").when(kind.rlike("(?i)html") | name.rlike(r"(?i)\.x?html?$"), "html")
        .when(kind.rlike("(?i)^text/|json") | name.rlike(r"(?i)\.(txt|md|markdown|csv|json|log|rst|xml|ya?ml)$"), "text").otherwise("unsupported")
    )


class _Archive:
    """Entries of a ZIP file, read as long as they expand to no more than a limit."""

    def __init__(self, data: bytes, most: int):
        self.file, self.left = zipfile.ZipFile(io.BytesIO(data)), most

    def read(self, name: str) -> bytes | None:
        try:
            info = self.file.getinfo(name)
        except KeyError:
            return None
        self.left -= info.file_size
        if self.left < 0:
            raise ValueError("too_large")
        return self.file.read(info)


def _title(xml: bytes | None) -> str | None:
    found = ET.fromstring(xml).find(f".//{_DC}title") if xml else None
    return (found.text or "").strip() or None if found is not None else None


def docx(data: bytes, most: int = MOST_EXPANDED) -> dict:
    archive = _Archive(data, most)
    root = ET.fromstring(archive.read("word/document.xml"))
    lines = ("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in root.iter(f"{_W}p"))
    return {"format": "docx", "title": _title(archive.read("docProps/core.xml")), "text": "\n\n".join(x for x in lines if x.strip())}


def epub(data: bytes, most: int = MOST_EXPANDED) -> dict:
    archive = _Archive(data, most)
    container = archive.read("META-INF/container.xml")
    rootfile = next((e for e in ET.fromstring(container).iter() if e.tag.endswith("rootfile")), None) if container else None
    path = rootfile.get("full-path") if rootfile is not None else None
    package = archive.read(path) if path else None
    if package is None:
        raise ValueError("invalid_document")
    root = ET.fromstring(package)
    items = {e.get("id"): e.get("href") for e in root.iter() if e.tag.endswith("}item")}
    spine = [items.get(e.get("idref")) for e in root.iter() if e.tag.endswith("}itemref")]
    chapters = []
    for href in filter(None, spine):
        name = posixpath.normpath(posixpath.join(posixpath.dirname(path), unquote(href.split("#")[0])))
        if (chapter := archive.read(name)) and (text := to_markdown(chapter.decode("utf-8", "replace"))["text"]):
            chapters.append(text)
    return {"format": "epub", "title": _title(package), "text": "\n\n".join(chapters)}


def extract(data: bytes, name: str = "", kind: str = "") -> dict:
    """format, title, text and error of a document; a PDF needs a reader that is not part of the engine."""
    try:
        if len(data) > MOST_BYTES:
            raise ValueError("too_large")
        low = name.lower()
        if data.startswith(b"%PDF-"):
            raise ValueError("unsupported_format")
        if data.startswith(b"PK\x03\x04"):
            names = zipfile.ZipFile(io.BytesIO(data)).namelist()
            if "word/document.xml" in names:
                return docx(data) | {"error": None}
            if (_Archive(data, MOST_EXPANDED).read("mimetype") or b"").strip() == b"application/epub+zip":
                return epub(data) | {"error": None}
            raise ValueError("unsupported_format")
        if "html" in kind.lower() or low.endswith((".html", ".htm", ".xhtml")):
            page = to_markdown(data.decode("utf-8", "replace"))
            return {"format": "html", "title": page["title"] or None, "text": page["text"], "error": None}
        if kind.lower().startswith("text/") or "json" in kind.lower() or low.endswith((".txt", ".md", ".markdown", ".csv", ".json", ".log", ".rst")):
            return {"format": "text", "title": None, "text": data.decode("utf-8", "replace"), "error": None}
        raise ValueError("unsupported_format")
    except ValueError as e:
        reason = str(e) if str(e) in ("too_large", "unsupported_format", "invalid_document") else "invalid_document"
    except (ET.ParseError, zipfile.BadZipFile, TypeError, KeyError):
        reason = "invalid_document"
    return {"format": None, "title": None, "text": None, "error": reason}


def extracted(files: DataFrame) -> DataFrame:
    """(path, format, title, text, error) of scanned files; text normalised and cut."""
    run = F.udf(lambda data, path: extract(bytes(data), path), "struct<format:string,title:string,text:string,error:string>", useArrow=True)
    out = files.select("path", run("content", "path").alias("e")).select("path", "e.format", "e.title", "e.text", "e.error")
    return out.withColumn("text", F.substring(normalize_text(F.col("text")), 1, MOST_CHARS))
