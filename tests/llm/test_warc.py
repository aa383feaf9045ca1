from __future__ import annotations

import base64
import gzip
import hashlib
import random
import zlib

import duckdb
import pytest

from larkspan.llm import warc

SCHEMA = "page_id long, url string, html string, size string, row string, sha1 string, kept string"


def plain(rows, least=1000):
    """[(page_id, bytes, sha1, kind, refers_to)]"""
    groups = {}
    for place, (page, _, html) in enumerate(rows):
        groups.setdefault((html or "").encode(), []).append((page is not None, page or 0, place, page))
    out = []
    for body, members in groups.items():
        members.sort(reverse=True)
        for number, (*_, page) in enumerate(members):
            copy = number > 0 and len(body) >= least
            out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if copy else "response", members[0][-1] if copy else None))
    return sorted(out, key=repr)


def sample():
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefgh <>/é\n") for _ in range(n))
    rows = [(i, f"http://h{i}.org/ü?{i}", text(rng.randrange(0, 3000))) for i in range(150)]
    hot = text(5000)
    rows += [(1000 + i, "http://hot.org", hot) for i in range(120)] + [(1119, "http://hot.org", hot)] * 3
    rows += [(2000, None, None), (2001, "", ""), (2002, "x\r\ny z", "a" * 999), (2003, "u", "a" * 999), (2004, "u", "b" * 1000), (2005, "u", "b" * 1000), (None, "u", "c" * 1500), (None, "v", "c" * 1500), (2006, "u", "\r\n\r\nHTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\n" + "d" * 1000), (2007, "u", "é" * 1_500_000)]
    return rows


def made(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)


def write(spark, rows, path, parts=4):
    made(spark, rows).repartition(parts).write.parquet(f"{path}/pages.parquet")


def test_the_query_against_a_plain_version_and_sql(spark, tmp_path):
    rows = sample()
    write(spark, rows, tmp_path)
    got = warc.op13_warc(spark, str(tmp_path))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    found = sorted((tuple(r) for r in got.collect()), key=repr)
    assert found == plain(rows)
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert sorted(duckdb.sql(warc.ORACLE_SQL).fetchall(), key=repr) == found


def test_an_empty_table(spark, tmp_path):
    write(spark, [], tmp_path, 1)
    assert warc.op13_warc(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("size", [211, 5000, 1 << 20])
def test_ranges_of_any_size_give_each_record_once(spark, size):
    rows = sample()
    _, files = warc.write_archives(made(spark, rows).repartition(3))
    records = warc.written_archives(spark, files, size).collect()
    whole = [r for r in records if r.type != "warcinfo"]
    assert len(whole) == len(rows) == sum(n for _, n, _ in files) and len(records) - len(whole) == len(files)
    for path, _, total in files:
        own = sorted((r.place, r.length) for r in records if r.archive == path)
        assert [p for p, _ in own] == [0, *(p + n for p, n in own)][:-1] and own[-1][0] + own[-1][1] == total


def test_payloads_targets_and_references(spark):
    rows = sample()
    _, files = warc.write_archives(made(spark, rows).repartition(3))
    got = warc.read_archives(spark.createDataFrame(files, warc.FILE), with_payload=True, range_bytes=3000).filter("type <> 'warcinfo'").collect()
    by_record = {r.record_id: r for r in got}
    assert len(by_record) == len(rows)
    texts = sorted(bytes(r.payload if r.type == "response" else by_record[r.refers_to].payload).decode() for r in got)
    assert texts == sorted(h or "" for _, _, h in rows)
    targets = {r.target_uri for r in got}
    assert "http://h3.org/ü?3" in targets and "x%0D%0Ay%20z" in targets and None in targets


def test_archives_are_plain_gzip_of_warc(spark):
    rows = [(1, "http://a.org/", "x" * 2000), (2, "http://b.org/", "x" * 2000)]
    _, files = warc.write_archives(made(spark, rows).repartition(1))
    text = b"".join(gzip.open(path.removeprefix("file://")).read() for path, *_ in files).decode()
    digest = base64.b32encode(hashlib.sha1(b"x" * 2000).digest()).decode()
    assert text.count("WARC/1.1\r\n") == 2 + len(files) and text.count("x" * 2000) == 1 and text.count(f"WARC-Payload-Digest: sha1:{digest}\r\n") == 2
    assert "WARC-Type: revisit" in text and f"WARC-Profile: {warc.PROFILE}\r\n" in text


def reader(data):
    return lambda at, n: data[at : at + n]


def other_record(kind, block, **fields):
    head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items())
    return gzip.compress(f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-Record-ID: <urn:x>\r\n{head}content-length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")


def test_other_writers_records():
    block = b"some bytes \x1f\x8b\x08 in it"
    data = other_record("resource", block, Content_Type="text/plain", X="a\r\n b") + other_record("metadata", b"") + other_record("resource", b"q", WARC_Payload_Digest="sha1:" + hashlib.sha1(b"q").hexdigest())
    rows = list(warc.records_of(reader(data), 0, len(data), True))
    assert [(r[2], r[-1]) for r in rows] == [("resource", block), ("metadata", b""), ("resource", b"q")]
    assert rows[0][6] == hashlib.sha1(block).hexdigest()


def test_places_that_only_look_like_members_are_passed_over(monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 50)
    one = other_record("resource", b"a" * 300)
    junk = warc.MAGIC + b"\0" * 20 + gzip.compress(b"no record") + b"\x1f\x8b"
    data = junk + one + junk + one
    rows = [r for begin in range(0, len(data), 7) for r in warc.records_of(reader(data), begin, begin + 7)]
    assert [(r[0], r[1]) for r in rows] == [(len(junk), len(one)), (2 * len(junk) + len(one), len(one))]


def test_damage_is_an_error():
    good = other_record("resource", b"abc", WARC_Payload_Digest="sha1:" + "0" * 40)
    with pytest.raises(ValueError, match="damaged"):
        list(warc.records_of(reader(good), 0, len(good)))
    cut = other_record("resource", random.Random(1).randbytes(100_000))[:-5000]
    with pytest.raises((EOFError, zlib.error)):
        list(warc.records_of(reader(cut), 0, len(cut)))
    short = gzip.compress(b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n")
    with pytest.raises(ValueError, match="as long as"):
        list(warc.records_of(reader(short), 0, len(short)))
