"""Archives that are written and read back; foreign, long and damaged ones."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.llm import warc

PAGES = "page_id long, url string, html string"


def brute(rows, least=1000):
    out, groups = [], {}
    for i, _, html in rows:
        groups.setdefault(html or "", []).append(i)
    for i, _, html in rows:
        raw, ids = (html or "").encode(), [x for x in groups[html or ""] if x is not None]
        first = max(ids) if ids and len(raw) >= least else i
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if first == i else "revisit", None if first == i else first))
    return sorted(out, key=str)


def found(df):
    rows = df.collect()
    assert all(r.verified for r in rows)
    return sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows], key=str)


def read(data: bytes, payloads=True):
    return list(warc.records(pa.PythonFile(io.BytesIO(data), "r"), payloads))


def test_round_trip(spark):
    rng, rows = random.Random(1), []
    for i in range(300):
        html = "<p>" + "".join(rng.choice("abc é\r\n\t\x00漢") for _ in range(rng.choice((0, 10, 996, 1200, 5000)))) + "</p>"
        rows.append((i, rng.choice((f"https://a.org/{i} x\r\nWARC-Type: warcinfo", None, "  ")), rows[rng.randrange(len(rows))][2] if rows and rng.random() < 0.4 else html))
    assert found(warc.archived(spark.createDataFrame(rows, PAGES).repartition(6))) == brute(rows)


def test_odd_pages(spark):
    long = "word " * 1_500_000
    rows = [(1, None, None), (2, "u", ""), (3, "u", "x" * 999), (4, "u", "x" * 999), (5, "u", "é" * 500), (6, None, "é" * 500), (None, "u", "é" * 500), (7, "u", long), (8, "u", long), (8, "u", long), (None, "u", "alone" * 300), (None, "u", "alone" * 300)]
    df = spark.createDataFrame(rows, PAGES).withColumns({x: F.lit("clash") for x in "page payload size digest response archive _first _salt record_id".split()})
    assert found(warc.archived(df)) == brute(rows)
    assert warc.archived(spark.createDataFrame([], PAGES)).count() == 0


def test_hot_payload_and_new_archives(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "hot " * 400 if i % 3 else f"{i} " * 500) for i in range(900)]
    archives = warc.write_archives(spark.createDataFrame(rows, PAGES), str(tmp_path), archive_bytes=20_000)
    listed = archives.collect()
    assert len(listed) > 3 and sum(r.records for r in listed) == 900
    (tmp_path / "left-behind.warc.gz").write_bytes(b"by a lost task")
    got = warc.read_archives(archives, payloads=True).collect()
    assert sum(r.record_type == "warcinfo" for r in got) == len(listed) and sum(r.record_type == "revisit" for r in got) == 599
    texts = {r.record_id.split(":")[2]: r.payload.decode() for r in got if r.record_type == "response"}
    assert all(texts[str(i)] == html for i, _, html in rows if i % 3 == 0 or i == 899)
    for r in listed:  # any gzip reader takes it, and each member is a record
        data = open(r.archive, "rb").read()
        assert len(data) == r.bytes and gzip.decompress(data).count(b"WARC/1.1\r\n") == r.records + 1
    by_archive = {}
    for r in got:
        by_archive.setdefault(r.archive, []).append(r.offset)
    for archive, offsets in by_archive.items():
        data = open(archive, "rb").read()
        for a, b in zip(sorted(offsets), [*sorted(offsets)[1:], len(data)], strict=True):
            one = zlib.decompressobj(31)
            one.decompress(data[a:b])
            assert one.eof and not one.unused_data


def foreign(kind="response", payload=b"hello", length=None, digest=None, end=b"\r\n\r\n", version=b"WARC/1.0", head=b"HTTP/1.0 200 OK\r\nX: y\r\n\r\n"):
    block = head + payload
    digest = hashlib.sha1(payload).hexdigest() if digest is None else digest
    fields = f"WARC-Type: {kind}\r\nwarc-record-id: <urn:a>\r\nWARC-Payload-Digest: sha1:{digest}\r\nX-Folded: one\r\n two\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: {len(block) if length is None else length}\r\n\r\n"
    return gzip.compress(version + b"\r\n" + fields.encode() + block + end)


def test_foreign_records():
    (r,) = read(foreign())
    assert r["payload"] == b"hello" and r["verified"] and r["payload_digest"] == hashlib.sha1(b"hello").hexdigest() and r["record_id"] == "urn:a"
    assert not read(foreign(digest="0" * 40))[0]["verified"]
    assert read(foreign(digest=base64.b32encode(hashlib.sha1(b"hello").digest()).decode()))[0]["verified"]
    assert read(foreign(head=b"HTTP/1.1 200 OK\n\n"))[0]["payload"] == b"hello"
    assert read(b"") == []


def test_long_records_are_read_in_pieces():
    payload = bytes(random.Random(0).randbytes(1 << 16)) * 100
    data = foreign(payload=payload) + foreign(payload=b"\0" * (40 << 20)) + foreign()
    got = read(data, payloads=False)
    assert [r["payload_bytes"] for r in got] == [len(payload), 40 << 20, 5] and all(r["verified"] and r["payload"] is None for r in got)


@pytest.mark.parametrize(
    ("bad", "why"),
    [
        (foreign(length=9999), "shorter"), (foreign(length=29), "longer"), (foreign(end=b""), "longer"), (foreign(version=b"HTTP/1.0"), "not a WARC"), (foreign()[:-20], "not inflated|ends within|longer"),
        (foreign(length="many"), "Content-Length"), (gzip.compress(b"WARC/1.0\r\nno colon\r\n\r\n"), "colon"), (gzip.compress(b"WARC/1.0\r\nA: b"), "without an end"), (b"not gzip at all", "not inflated"), (foreign(head=b"HTTP/1.0 200 OK\r\n", payload=b""), "without an end"),
    ],
)
def test_damage_is_told_and_passed_over(bad, why):
    import re

    got = read(foreign(payload=b"before") + bad + foreign(payload=b"after"))
    assert [r.get("payload") for r in got] == [b"before", None, b"after"]
    assert re.search(why, got[1]["error"]) and got[1]["offset"] == len(foreign(payload=b"before"))


def test_truncated_archive():
    got = read(foreign(payload=b"before") + foreign()[:-30])
    assert got[0]["payload"] == b"before" and got[1]["error"] == "the archive ends within a record" and len(got) == 2
