"""ARC archives, their conversion to WARC, and reading back."""

import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from tablescope.llm import warc
from tablescope.session import scratch_folder


def old_archive(version):
    """An archive as an old crawler may have left it: urls with spaces, blank lines, junk, a short last record."""
    fields = warc.ARC_FIELDS[version]
    body = f"{version} 0 Crawler\n{' '.join(fields)}\n\n".encode()
    tail = "" if version == 1 else "200 - - 0 old.arc "
    out = f"filedesc://old.arc 0.0.0.0 19990102030405 text/plain {tail}{len(body)}\n".encode() + body
    def put(url, mime, block, length=None, date="19990102"):
        middle = "" if version == 1 else "200 abc - 17 old.arc "
        return f"{url} 10.1.2.3 {date} {mime} {middle}{len(block) if length is None else length}\n".encode() + block + b"\n"
    out += put("http://a.example/x y", "text/html", b"HTTP/1.0 200 OK\r\nX: 1\r\n\r\nbody\r\n\r\nWARC/1.1 \xff\xfe")
    out += b"\n\nthis is no header line\n"
    out += put("dns:a.example", "text/dns", b"19990102\na.example. 60 IN A 10.1.2.3\n")
    out += put("http://a.example/empty", "no-type", b"", date="not-a-date")
    return out + put("http://a.example/cut", "text/html", b"HTTP/1.0 200 OK\r\n\r\nshort", length=5000)[:-1]


def test_header_lines_by_version():
    for version in (1, 2):
        for data in (old_archive(version), gzip.compress(old_archive(version))):
            rows = list(warc.parse_arc(data))
            assert [warc.record_type(r) for r in rows] == ["warcinfo", "response", "resource", "resource", "response"]
            assert all(r["version"] == version and r["name"] == "old.arc" for r in rows)
            assert rows[1]["fields"]["URL"] == "http://a.example/x y" and rows[1]["block"].endswith(b"\xff\xfe")
            assert rows[1]["fields"].get("Checksum") == (None if version == 1 else "abc")
            assert [r["truncated"] for r in rows] == [False] * 4 + [True]
            assert rows[4]["block"].endswith(b"short")
    assert list(warc.parse_arc(b"")) == [] and list(warc.parse_arc(b"junk\n\n")) == []


def test_warc_records_are_synthesised():
    rows = list(warc.parse_arc(old_archive(2)))
    data = b"".join(warc.warc_record(r, None) for r in rows)
    back = list(warc.parse_warc(data))
    assert [b["fields"]["warc-type"] for b in back] == ["warcinfo", "response", "resource", "resource", "response"]
    assert [b["block"] for b in back[1:]] == [r["block"] for r in rows[1:]]
    first = back[1]["fields"]
    assert first["warc-date"] == "1999-01-02T00:00:00Z" and back[3]["fields"]["warc-date"] == "1970-01-01T00:00:00Z"
    assert first["warc-ip-address"] == "10.1.2.3" and first["warc-target-uri"] == "http://a.example/x y"
    payload = b"body\r\n\r\nWARC/1.1 \xff\xfe"
    assert first["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    assert "warc-truncated" in back[4]["fields"] and "warc-truncated" not in first
    assert back[2]["fields"]["content-type"] == "text/dns"
    assert len({b["fields"]["warc-record-id"] for b in back}) == 5
    assert [warc.record_id(r) for r in warc.parse_arc(old_archive(2))] == [warc.record_id(r) for r in rows]
    again = list(warc.parse_warc(warc.warc_record(rows[1], {"id": "<urn:x>", "url": "http://b/", "date": "2001"})))[0]
    assert again["block"] == b"HTTP/1.0 200 OK\r\nX: 1\r\n\r\n" and again["fields"]["warc-refers-to"] == "<urn:x>"
    assert again["fields"]["warc-refers-to-date"] == "2001-01-01T00:00:00Z"


PAGES = "page_id long, url string, html string, id string, type string, path int, offset int"


def expected(rows):
    """Sorted (page, bytes, digest, type, refers_to); of rows equal in id and payload any may be the response."""
    keep = {}
    for p, _, html, *_ in rows:
        html = (html or "").encode()
        keep[html] = max(keep.get(html, -1), -1 if p is None else p)
    out, used = [], set()
    for p, _, html, *_ in rows:
        html = (html or "").encode()
        own = len(html) < 1000 or keep[html] == (-1 if p is None else p) and html not in used
        if own and len(html) >= 1000:
            used.add(html)
        kept = None if keep[html] == -1 else keep[html]
        out.append((p, len(html), hashlib.sha1(html).hexdigest(), "response" if own else "revisit", None if own else kept))
    return sorted(out, key=str)


def test_pages_round_trip(spark):
    big, bigger = "é" * 600, "<p>\r\n\r\nWARC/1.1\r\n\x00☃</p>" * 90
    rows = [(1, "http://a/", big), (2, "http://b/ c\n", big), (9, None, big), (4, "", "x" * 999), (5, "http://é/", "x" * 999),
            (6, "u", ""), (7, "u", None), (None, "u", bigger), (None, "u", bigger), (3, "u", "z" * 70_000), (3, "u", "z" * 70_000),
            (8, "dns:x", "y" * 1000)]
    rows = [(*r, "x", "y", 1, 2) for r in rows]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    folder = scratch_folder(spark, "test-archives")
    got = warc.archive_pages(pages, folder, archive_bytes=5000)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.type, r.refers_to) for r in got.collect()), key=str) == expected(rows)
    assert got.where(~F.col("intact")).count() == 0
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/arc").select("content").collect()
    parsed = [list(warc.parse_arc(bytes(f.content))) for f in files]
    assert len(files) > 3 and {p[0]["version"] for p in parsed} == {1, 2}
    assert sum(len(p) - 1 for p in parsed) == len(rows)
    # The offsets that version 2 declares are where the records start.
    assert all(int(r["fields"]["Offset"]) == r["offset"] for p in parsed for r in p[1:] if r["version"] == 2)


def test_old_archives_through_spark(spark):
    folder = scratch_folder(spark, "old")
    data = [(bytearray(old_archive(1)),), (bytearray(old_archive(2)),)]
    warc._write_archives(spark.createDataFrame(data, "content binary"), f"{folder}/arc")
    index = warc.read_arc(spark, f"{folder}/arc")
    assert index.count() == 8 and index.where("truncated").count() == 2
    warc.convert_arc(spark, f"{folder}/arc", f"{folder}/warc", least_bytes=1)
    back = warc.read_warc(spark, f"{folder}/warc").collect()
    assert all(r.intact for r in back) and sorted(r.type for r in back) == ["resource"] * 4 + ["response"] * 3 + ["revisit"]


def test_no_pages(spark):
    nothing = spark.createDataFrame([], PAGES)
    assert warc.archive_pages(nothing, scratch_folder(spark, "none")).count() == 0
