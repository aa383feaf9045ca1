"""WARC archives: one gzip member a record, copies as revisits, and a reader that splits archives by byte ranges.

A task of the reader gets a range of an archive. It looks for the three bytes with which a gzip member begins, takes a
place for a record's if what it decodes to begins a WARC header, and owns the records that begin inside its range, to
whose end it reads on. Every record begins in one range, so it is read once, whatever the ranges.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm.common import discard, materialize, new_path, table

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes that come from the store at once, that the decoder gets at once, and that it returns at most at once.
CHUNK, FEED, PIECE = 1 << 20, 1 << 14, 1 << 18
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
_ID = r"^<urn:x-page:(.*):\d+>$"
FILE = "path string, records long, bytes long"


def page_urn(page: int | None, row: int) -> str:
    return f"<urn:x-page:{'' if page is None else page}:{row}>"


def _member(kind: str, record: str, date: str, fields: list[tuple[str, str | None]], block: list[bytes], level: int) -> bytes:
    """A record as a gzip member."""
    named = [("WARC-Type", kind), ("WARC-Record-ID", record), ("WARC-Date", date), *fields, ("Content-Length", str(sum(map(len, block))))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named if v is not None) + "\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return b"".join([packer.compress(head.encode()), *(packer.compress(part) for part in block), packer.compress(b"\r\n\r\n"), packer.flush()])


def page_member(page: int | None, row: int, url: str | None, payload: bytes, sha1: str, size: int, refers: str | None, date: str, level: int = 6) -> bytes:
    """The record of a page: a response with its payload or, where it refers to another's, a revisit without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    target = None if url is None else _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)
    digest = "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()
    fields = [("WARC-Target-URI", target), ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")]
    if refers is None:
        return _member("response", page_urn(page, row), date, fields, [http, payload], level)
    return _member("revisit", page_urn(page, row), date, [*fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To", refers)], [http], level)


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000, folder: str | None = None, date: str = "2000-01-01T00:00:00Z") -> tuple[str, list[tuple[str, int, int]]]:
    """Write a record for every row; returns the folder and (path, records, bytes) of each archive.

    Of rows with equal payloads of at least `least` bytes that with the largest id (of equal ids, one of them) becomes a
    response, the others revisits that refer to it. Equality is that of SHA-256 and length; the digests travel without
    the payloads, counted and folded in each task before the shuffle. The payloads then meet their group's largest id in
    a left join, whose hot groups adaptive execution splits. Each attempt of a task writes an archive of its own and
    tells its name, so those of lost attempts are named nowhere; `folder` must be on a store that pyarrow can write.

    Defined results: a null payload is an empty one; a null id is smaller than any other and is left empty in the record's
    name; a null url leaves the record without a target; white space and control characters of a url are percent-encoded;
    repeated rows are records of their own; other columns are not read; an empty table gives no archive with a page.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    store, place = pafs.FileSystem.from_uri(folder)
    store.create_dir(place, recursive=True)
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "sha2": F.unhex(F.sha2("payload", 256)), "row": F.monotonically_increasing_id()})
    # Rows get their numbers once: what is computed again after a loss must not number them otherwise.
    staged = materialize(rows, "pages")
    groups = staged.filter(F.col("size") >= least).groupBy("sha2", "size").agg(F.max(F.struct("page", "row")).alias("kept"), F.count("*").alias("copies")).filter("copies > 1")
    joined = staged.join(groups, ["sha2", "size"], "left").select("page", "row", "url", F.expr("IF(kept.row <> row, X'', payload)").alias("payload"), F.sha1("payload").alias("sha1"), "size", F.expr("IF(kept.row <> row, kept, NULL)").alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_store, base = pafs.FileSystem.from_uri(folder)
        name = f"pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        records = 0
        with out_store.open_output_stream(f"{base}/{name}", compression=None) as out:
            about = b"software: larkspan\r\nformat: WARC File Format 1.1\r\n"
            total = out.write(_member("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", date, [("WARC-Filename", name), ("Content-Type", "application/warc-fields")], [about], 6))
            for batch in batches:
                for page, row, url, body, sha1, size, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    total += out.write(page_member(page, row, url, body, sha1, size, refers and page_urn(refers["page"], refers["row"]), date))
                    records += 1
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([records], pa.int64()), pa.array([total], pa.int64())], ["path", "records", "bytes"])

    files = sorted(tuple(r) for r in joined.mapInArrow(run, FILE).collect())
    discard(staged)
    return folder, files


class Window:
    """The bytes of a file by place, of which one chunk is held."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read, self.start, self.held = read, 0, b""

    def at(self, place: int) -> tuple[bytes, int]:
        """(chunk, where in it `place` lies); the chunk ends there at the file's end."""
        if not self.start <= place < self.start + len(self.held):
            self.start, self.held = place, self.read(place, CHUNK)
        return self.held, place - self.start

    def find_magic(self, place: int, end: int) -> int | None:
        """The first place before `end` at which a member may begin."""
        while place < end:
            held, inside = self.at(place)
            found = held.find(MAGIC, inside)
            if found >= 0:
                return self.start + found if self.start + found < end else None
            if len(held) - inside < len(MAGIC):
                # Too little is left to tell: load from here on.
                self.start, self.held = place, self.read(place, CHUNK)
                if len(self.held) < len(MAGIC):
                    return None
                continue
            place = self.start + len(held) - len(MAGIC) + 1
        return None


class Decoded:
    """What a gzip member decodes to, in pieces, and where it ends."""

    def __init__(self, window: Window, place: int):
        self.window, self.place, self.end = window, place, -1
        self.pieces = self._pieces()
        self.held = b""

    def _pieces(self) -> Iterator[bytes]:
        opened, place, data = zlib.decompressobj(31), self.place, b""
        while not opened.eof:
            if not data:
                held, inside = self.window.at(place)
                data = held[inside : inside + FEED]
                place += len(data)
            out = opened.decompress(data, PIECE)
            if not (out or data or opened.eof):
                raise EOFError("the member has no end")
            data = opened.unconsumed_tail
            if out:
                yield out
        self.end = place - len(opened.unused_data)

    def until(self, mark: bytes) -> bytes:
        """All up to and with `mark`; without one, all."""
        seen = 0
        while (found := self.held.find(mark, max(0, seen - len(mark) + 1))) < 0:
            seen = len(self.held)
            piece = next(self.pieces, None)
            if piece is None:
                out, self.held = self.held, b""
                return out
            self.held += piece
        out, self.held = self.held[: found + len(mark)], self.held[found + len(mark) :]
        return out

    def rest(self) -> Iterator[bytes]:
        if self.held:
            yield self.held
            self.held = b""
        yield from self.pieces


def _fields(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name; lines that begin blank go on the one before."""
    out: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, value = line.split(":", 1)
            last = last.strip().lower()
            out[last] = value.strip()
    return out


def _hex_digest(value: str | None) -> str | None:
    """The digest of a `sha1:` field, which writers give in base 32 or in hex."""
    if not value or not value.lower().startswith("sha1:"):
        return None
    bare = value[5:].strip()
    return bare.lower() if len(bare) == 40 else base64.b32decode(bare.upper()).hex()


def read_record(decoded: Decoded, with_payload: bool) -> tuple | None:
    """(type, record id, target, refers to, digest, bytes, payload) of a member; None if it holds no WARC record.

    The digest and the size of what is stored are those of its bytes and must agree with the header; a revisit's are the
    header's.
    """
    try:
        first = next(decoded.pieces, b"")
        while len(first) < 5 and (more := next(decoded.pieces, b"")):
            first += more
    except (zlib.error, EOFError):
        return None
    if not first.startswith(b"WARC/"):
        return None
    decoded.held = first
    fields = _fields(decoded.until(b"\r\n\r\n"))
    block = int(fields["content-length"])
    http = fields.get("content-type", "").startswith("application/http")
    head = decoded.until(b"\r\n\r\n") if http and block else b""
    size, digest, kept, ahead = 0, hashlib.sha1(usedforsecurity=False), [], b""
    for piece in decoded.rest():
        # The last four bytes end the record and are no part of its block.
        piece = ahead + piece
        piece, ahead = piece[:-4], piece[-4:]
        size += len(piece)
        digest.update(piece)
        if with_payload:
            kept.append(piece)
    if size + len(head) != block or ahead != b"\r\n\r\n":
        raise ValueError(f"the record at {decoded.place} is not as long as it says")
    stated, kind = _hex_digest(fields.get("warc-payload-digest")), fields["warc-type"]
    if kind == "revisit":
        size = int(_fields(head).get("content-length", -1)) if head else -1
        return kind, fields["warc-record-id"], fields.get("warc-target-uri"), fields.get("warc-refers-to"), stated, size if size >= 0 else None, None
    if stated is not None and stated != digest.hexdigest():
        raise ValueError(f"the payload of the record at {decoded.place} is damaged")
    return kind, fields["warc-record-id"], fields.get("warc-target-uri"), fields.get("warc-refers-to"), digest.hexdigest(), size, b"".join(kept) if with_payload else None


def records_of(read: Callable[[int, int], bytes], start: int, end: int, with_payload: bool = False) -> Iterator[tuple]:
    """(place, length, *read_record) of the records that begin from `start` to before `end`."""
    window, place = Window(read), start
    while (found := window.find_magic(place, end)) is not None:
        decoded = Decoded(window, found)
        record = read_record(decoded, with_payload)
        if record is None:
            place = found + 1
            continue
        place = decoded.end
        yield found, place - found, *record


RECORD = "archive string, place long, length long, type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long"


def read_archives(files: DataFrame, with_payload: bool = False, range_bytes: int = 16 << 20, tasks: int | None = None) -> DataFrame:
    """A row for each record of archives with one record a gzip member: `RECORD`, and `payload` on request.

    files: (path, bytes), of which each is read in ranges of `range_bytes`, in as many tasks as there are ranges or, if given,
    `tasks`. A task holds a chunk of a file and, on request, the payloads of a batch. A range without the beginning of a record
    gives no row; a record that is damaged is an error; null and empty files have no rows. Payloads that are text can't
    hold the bytes of a member's beginning as they are, so no copy of an archive inside one is taken for a record.
    """
    ranges = files.filter("bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = ranges.repartition(tasks) if tasks else ranges.repartition("path", "start")
    schema = RECORD + (", payload binary" if with_payload else "")
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), *[pa.binary()] * with_payload]
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, place = pafs.FileSystem.from_uri(path)
                held, size = [], 0
                with store.open_input_file(place) as file:
                    for row in records_of(lambda at, n, f=file: f.read_at(n, at), start, start + range_bytes, with_payload):
                        held.append((path, *row) if with_payload else (path, *row[:-1]))
                        size += len(row[-1] or b"") + 200
                        if size > 8 << 20:
                            yield made(held)
                            held, size = [], 0
                if held:
                    yield made(held)

    return ranges.mapInArrow(run, schema)


def written_archives(spark: SparkSession, files: list[tuple[str, int, int]], range_bytes: int = 16 << 20) -> DataFrame:
    """read_archives of what write_archives wrote."""
    return read_archives(spark.createDataFrame(files, FILE), range_bytes=range_bytes, tasks=max(1, sum(-(-size // range_bytes) for *_, size in files)))


def op13_warc(spark, sf_dir: str) -> DataFrame:
    _, files = write_archives(table(spark, sf_dir, "pages"))
    records = written_archives(spark, files).filter("type IN ('response', 'revisit')")
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '{_ID}', 1) AS bigint)".replace("\\", "\\\\"))
    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page("refers_to").alias("refers_to"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
t AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest, b FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY page_id DESC NULLS LAST) AS place,
        first_value(page_id) OVER (PARTITION BY b ORDER BY page_id DESC NULLS LAST) AS kept FROM t)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND place > 1 THEN kept END AS refers_to
FROM k
"""
