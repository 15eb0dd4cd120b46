"""Legacy ARC archives and their conversion to WARC.

Captures are packed into ARC archives (header lines of version 1 or 2,
declared lengths).  The converter parses the header lines by the archive's own
version, cuts records by declared length, and writes WARC archives with
synthesised record ids, timestamps, types and digests; equal payloads become
revisits of one response.  All files are written by Spark, gzip-compressed,
and read through Spark's readers, so any store will do.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

# The fields of a record's header line, by version.
ARC_FIELDS = {1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
              2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset",
                  "Filename", "Archive-length")}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# -- ARC

def _token(text: str | None) -> str:
    """A header field: white space, controls and code points above ASCII as percent escapes, ``-`` for nothing."""
    out = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in text or "")
    return out or "-"


def arc_start(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 tablescope\n{' '.join(ARC_FIELDS[version])}\n".encode()
    middle = "" if version == 1 else f"200 - - 0 {name} "
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {middle}{len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, name: str, offset: int, url: str, ip: str, date: str, mime: str, status: int, block: bytes) -> bytes:
    middle = "" if version == 1 else f"{status} - - {offset} {name} "
    return f"{_token(url)} {_token(ip)} {date} {_token(mime)} {middle}{len(block)}\n".encode() + block + b"\n"


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC archive: offset, name of the archive, version, header fields, block, truncated.

    The version block names the version and its fields.  Blank lines between
    records and lines that are no header are passed over; a block that ends
    before its declared length is truncated.
    """
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    names, version, name, at = ARC_FIELDS[1], 1, "", 0
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end].rstrip(b"\r").decode("utf-8", "replace")
        offset, at = at, end + 1
        desc = line.startswith("filedesc://")
        # URLs may hold spaces: fields are counted from the right.
        fields = [line.split(" ", 1)[0], *line.rsplit(" ", 3)[1:]] if desc else line.rsplit(" ", len(names) - 1)
        length = fields[-1]
        if not desc and len(fields) != len(names) or not (length.isascii() and length.isdigit()):
            continue
        block = data[at:at + int(length)]
        at += int(length)
        if desc:
            name = line.split(" ", 1)[0][len("filedesc://"):]
            head = block.decode("utf-8", "replace").split("\n")
            version = int(head[0].split(" ", 1)[0]) if head[0][:1].isdigit() else 1
            names = tuple(head[1].split()) if len(head) > 1 and head[1].strip() else ARC_FIELDS.get(version, ARC_FIELDS[1])
            known = dict(zip(("URL", "IP-address", "Archive-date"), line.split(" ")))
        else:
            known = dict(zip(names, fields))
        yield {"offset": offset, "name": name, "version": version, "fields": known, "block": block,
               "truncated": len(block) < int(length)}


# -- WARC

def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """Head (with its blank line) and payload of an HTTP message; blocks of another kind are payload throughout."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = block.find(b"\r\n\r\n")
    return (block, b"") if end < 0 else (block[:end + 4], block[end + 4:])


def http_field(head: bytes, name: bytes) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name:
            return value.strip().decode("utf-8", "replace")
    return None


def warc_date(date: str) -> str:
    """ISO time of a date of up to 14 digits; missing digits are the earliest, what is no date is 1970."""
    full = (date + "00000101000000"[len(date):])[:14]
    try:
        return datetime.strptime(full, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ").rjust(20, "0")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def record_id(record: dict) -> str:
    """The same record of the same archive always has the same id."""
    key = f"{record['name']}\n{record['offset']}\n{record['fields'].get('URL')}\n{record['fields'].get('Archive-date')}"
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(key.encode('utf-8', 'replace')).digest()[:16], version=5)}>"


def record_type(record: dict) -> str:
    url = record["fields"].get("URL", "")
    return "warcinfo" if url.startswith("filedesc://") else "response" if record["block"].startswith(b"HTTP/") else "resource"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(record: dict, refers: dict | None) -> bytes:
    """The WARC record of a parsed ARC record; with ``refers`` (id, url, date) a revisit, which leaves the payload out."""
    fields, block, kind = record["fields"], record["block"], record_type(record)
    head, payload = http_parts(block)
    lines = ["WARC/1.1"]
    put = lambda name, value: lines.append(f"{name}: {value}")
    put("WARC-Type", "revisit" if refers else kind)
    put("WARC-Record-ID", record_id(record))
    put("WARC-Date", warc_date(fields.get("Archive-date", "")))
    if kind == "warcinfo":
        put("WARC-Filename", record["name"])
        put("Content-Type", "application/warc-fields")
        block = f"software: tablescope\r\nformat: WARC/1.1\r\nconverted-from: ARC/{record['version']}\r\n".encode()
    else:
        put("WARC-Target-URI", fields.get("URL", "-"))
        if fields.get("IP-address", "0.0.0.0") not in ("0.0.0.0", "-"):
            put("WARC-IP-Address", fields["IP-address"])
        put("WARC-Payload-Digest", _sha1(payload))
        if refers:
            put("WARC-Profile", REVISIT_PROFILE)
            put("WARC-Refers-To", refers["id"])
            put("WARC-Refers-To-Target-URI", refers["url"])
            put("WARC-Refers-To-Date", warc_date(refers["date"]))
            block = head
        if record["truncated"]:
            put("WARC-Truncated", "length")
        put("Content-Type", "application/http;msgtype=response" if kind == "response" else fields.get("Content-type", "-"))
    put("WARC-Block-Digest", _sha1(block))
    put("Content-Length", len(block))
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[dict]:
    """Records of a WARC archive: offset, named fields (lower case) and block, cut by declared length."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        fields = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            key, _, value = line.partition(":")
            fields[key.strip().lower()] = value.strip()
        start = end + 4
        stop = start + int(fields["content-length"])
        yield {"offset": at, "fields": fields, "block": data[start:stop]}
        at = stop


# -- Spark

def http_captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  date: str = "20000101000000") -> DataFrame:
    """(url, ip, date, mime, status, block): HTTP messages whose head names the page's id and length; null html is empty."""
    body = F.encode(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), "UTF-8")
    key = F.col(f"`{id_col}`").cast("long").cast("string")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
                    F.coalesce(F.concat(F.lit("X-Page-Id: "), key, F.lit("\r\n")), F.lit("")),
                    F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(F.col(f"`{url_col}`").alias("url"), F.lit("0.0.0.0").alias("ip"), F.lit(date).alias("date"),
                        F.lit("text/html").alias("mime"), F.lit(200).alias("status"),
                        F.concat(F.encode(head, "UTF-8"), body).alias("block"))


def _write_archives(archives: DataFrame, folder: str) -> None:
    """One file per row of ``content``; the writer adds the last line end."""
    (archives.select(F.col("content").cast("string").alias("value"))
     .write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(folder))


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")


def write_arc(captures: DataFrame, folder: str, archive_bytes: int = 8 << 20, versions: tuple[int, ...] = (1, 2)) -> None:
    """Packs ``captures`` into ARC archives of about ``archive_bytes``, versions in turn; a larger record has its own archive.

    Urls, addresses and types are written as ASCII tokens without spaces; null
    and empty ones as ``-``.  An empty table writes no archive.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, number = TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                for r in batch.slice(low, 64).to_pylist():
                    if not held:
                        version = versions[(part + number) % len(versions)]
                        name = f"part-{part:06d}-{number:06d}.arc"
                        held.append(arc_start(name, version, r["date"]))
                        size = len(held[0])
                    held.append(arc_record(version, name, size, r["url"], r["ip"], r["date"], r["mime"], r["status"], r["block"]))
                    size += len(held[-1])
                    if size >= archive_bytes:
                        yield _content(held)
                        held, number = [], number + 1
        if held:
            yield _content(held)

    _write_archives(captures.mapInArrow(pack, "content binary"), folder)


def _content(records: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b"".join(records)[:-1]], pa.binary())], names=["content"])


def _key(head: bytes, field: bytes) -> int | None:
    value = http_field(head, field)
    return int(value) if value is not None and value.removeprefix("-").isdigit() and value.isascii() else None


def read_arc(spark: SparkSession, folder: str) -> DataFrame:
    """(path, offset, version, type, id, url, date, page_id, bytes, digest, truncated): the index of all records but the version blocks.

    ``bytes`` and ``digest`` (SHA-1) are those of the payload.  An archive is
    parsed whole by one task; those of ``write_arc`` are bounded.
    """
    schema = ("path string, offset long, version int, type string, id string, url string, date string, page_id long, "
              "bytes long, digest binary, truncated boolean")
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows = []
                for r in parse_arc(content.as_py()):
                    kind = record_type(r)
                    if kind != "warcinfo":
                        head, payload = http_parts(r["block"])
                        rows.append((path.as_py(), r["offset"], r["version"], kind, record_id(r), r["fields"].get("URL"),
                                     r["fields"].get("Archive-date"), _key(head, b"x-page-id"), len(payload),
                                     hashlib.sha1(payload).digest(), r["truncated"]))
                types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(),
                         pa.int64(), pa.binary(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return _files(spark, folder).mapInArrow(index, schema)


def convert_arc(spark: SparkSession, arc_folder: str, warc_folder: str, least_bytes: int = 1000) -> None:
    """Writes a WARC archive for every ARC archive of a folder.

    Of the whole HTTP responses with equal payloads of at least ``least_bytes`` bytes,
    over all archives, the one with the largest page id stays a response (null
    is least; ties to the later archive and offset); the others are revisits of
    it.  ``filedesc`` records become warcinfo, messages without an HTTP head
    resources.  Truncated records are converted with what they hold.
    """
    index = stored(read_arc(spark, arc_folder).where(
        (F.col("type") == "response") & (F.col("bytes") >= least_bytes) & ~F.col("truncated")), "arc-index")
    # One row per payload that occurs again: combined map-side, so copies without number meet in no task.
    kept = stored(index.groupBy("digest", "bytes").agg(
        F.max(F.struct("page_id", "path", "offset", "id", "url", "date")).alias("kept"), F.count("*").alias("n"))
        .where("n > 1").drop("n"), "arc-kept")
    again = index.select("path", "offset", "digest", "bytes").join(kept, ["digest", "bytes"]).where(
        (F.col("path") != F.col("kept.path")) | (F.col("offset") != F.col("kept.offset")))
    # An archive is bounded, and so is the list of its revisits.
    lists = again.groupBy("path").agg(F.collect_list(F.struct(
        "offset", F.col("kept.id").alias("id"), F.col("kept.url").alias("url"), F.col("kept.date").alias("date"))).alias("again"))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, revisits in zip(batch.column(0), batch.column(1)):
                refers = {r["offset"]: r for r in revisits.as_py() or ()}
                out = [warc_record(r, refers.get(r["offset"])) for r in parse_arc(content.as_py())]
                if out:
                    yield _content(out)

    files = _files(spark, arc_folder).join(lists.hint("shuffle_hash"), "path", "left").select("content", "again")
    _write_archives(files.mapInArrow(convert, "content binary"), warc_folder)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """(path, offset, type, id, url, date, page_id, payload_bytes, payload_digest, refers_id, intact): all records but warcinfo.

    ``payload_digest`` is the declared one in lower-case hex; a revisit's
    length is its HTTP head's.  ``intact`` tells whether block and, but for
    revisits, payload have the declared digests.
    """
    schema = ("path string, offset long, type string, id string, url string, date string, page_id long, payload_bytes long, "
              "payload_digest string, refers_id string, intact boolean")
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(),
                 pa.string(), pa.bool_()]
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows = []
                for r in parse_warc(content.as_py()):
                    fields, block = r["fields"], r["block"]
                    kind = fields["warc-type"]
                    if kind == "warcinfo":
                        continue
                    head, payload = http_parts(block)
                    declared = fields["warc-payload-digest"]
                    intact = _sha1(block) == fields["warc-block-digest"] and (kind == "revisit" or _sha1(payload) == declared)
                    rows.append((path.as_py(), r["offset"], kind, fields["warc-record-id"], fields["warc-target-uri"], fields["warc-date"],
                                 _key(head, b"x-page-id"), _key(head, b"content-length") if kind == "revisit" else len(payload),
                                 base64.b32decode(declared.removeprefix("sha1:")).hex(), fields.get("warc-refers-to"), intact))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return _files(spark, folder).mapInArrow(read, schema)


def referred_pages(records: DataFrame) -> DataFrame:
    """``records`` with ``refers_to``: the page id of the response that a revisit names, null where there is none."""
    responses = records.where(F.col("type") != "revisit").select(F.col("id").alias("_id"), F.col("page_id").alias("refers_to"))
    return records.join(responses, F.col("refers_id") == F.col("_id"), "left").drop("_id")


def archive_pages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  least_bytes: int = 1000, archive_bytes: int = 8 << 20) -> DataFrame:
    """Pages as ARC archives in ``folder``/arc, converted to WARC in ``folder``/warc, and the records read back from there.

    One record per row of ``pages``; repeated rows are records of their own, of
    which all but one revisit.  Null html is an empty payload, a null id stays
    null, a null url is ``-``.  Very long pages have an archive of their own.
    An empty table gives no records; other columns, whatever their names, are
    not read.
    """
    spark = pages.sparkSession
    write_arc(http_captures(pages, id_col, url_col, html_col), f"{folder}/arc", archive_bytes)
    convert_arc(spark, f"{folder}/arc", f"{folder}/warc", least_bytes)
    return referred_pages(stored(read_warc(spark, f"{folder}/warc"), "warc-records"))
