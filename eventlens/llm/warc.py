"""Legacy ARC to WARC conversion.

ARC files open with a version block (filedesc://) that names the version of the record header lines:
version 1 is "URL IP date type length", version 2 "URL IP date type status checksum location offset file length".
A record is its header line, as many bytes as the declared length, and a newline. Three passes, each over files on the
shared file system:

1. Pages are written as gzipped ARC files of both versions. The page's id travels in the record's HTTP head.
2. The ARC files are scanned for their payload digests; of equal payloads the record with the largest id is the response.
3. Each ARC file is converted into a WARC file by its header lines and declared lengths; ids, dates, types and digests are
   synthesised. No payload is shuffled: a task gets the file's name and the few records in it that revisit others.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import blobs, plain, scratch_path, slices, written
from eventlens.llm.files import RollingWriter, batches_of, open_file, spread

#: The HTTP header that carries a page's id.
SOURCE_HEADER = "X-Source-Id"

#: Field names of the header lines, by version (fixed values of the format).
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "file", "length"),
}


class ArcRecord(NamedTuple):
    fields: dict
    content: bytes


def arc_version_block(version: int, name: str = "legacy.arc", date: str = "20240101000000") -> bytes:
    body = f"{version} 0 eventlens\n{'URL IP-address Archive-date Content-type Archive-length' if version == 1 else 'URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length'}\n\n".encode()
    extra = "" if version == 1 else f" 200 - - 0 {name}"
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{extra} {len(body)}\n".encode() + body


def arc_record(version: int, url: str, date: str, mime: str, content: bytes, offset: int = 0, name: str = "legacy.arc") -> bytes:
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) or "-"
    middle = "" if version == 1 else f" 200 - - {offset} {name}"
    return f"{url} 0.0.0.0 {date} {mime}{middle} {len(content)}\n".encode() + content + b"\n"


def _declared(words: list[str], content: bytes, first: bool) -> int | None:
    """The version that a record declares, if it is a version block: the first of its file, or one of another file put behind it.

    A page may bear any URL; what makes a block is its place, or its type and the line of field names in its content.
    """
    if not words[0].startswith("filedesc:") or not first and words[3] != "text/plain":
        return None
    found = re.match(rb"(\d+) \d+ [^\n]*\nURL IP-address Archive-date ", content)
    if found is None and not first:
        return None
    version = int(found[1]) if found else int(content.split(b" ", 1)[0])
    if version not in ARC_FIELDS:
        raise ValueError(f"ARC version {version}")
    return version


def read_arc(stream) -> Iterator[ArcRecord]:
    """Records of an ARC stream, each by the header line of the version that the last version block declared."""
    version, first = 1, True
    while line := stream.readline():
        if line == b"\n":
            continue
        words = line.decode("utf-8", "replace").rstrip("\n").split(" ")
        if len(words) not in map(len, ARC_FIELDS.values()) or not words[-1].isdigit():
            raise ValueError(f"bad ARC header line: {line[:80]!r}")
        content = stream.read(int(words[-1]))
        if len(content) != int(words[-1]):
            raise ValueError("ARC record is shorter than declared")
        declared, first = _declared(words, content, first), False
        if declared is not None:
            version = declared
            continue
        if len(words) != len(ARC_FIELDS[version]):
            raise ValueError(f"bad ARC header line: {line[:80]!r}")
        yield ArcRecord(dict(zip(ARC_FIELDS[version], words, strict=True)), content)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def place_mark(file: str, k: int) -> int:
    """46 bits of where a record stands: they tell records of one source id apart."""
    return int.from_bytes(hashlib.sha1(f"{file}:{k}".encode()).digest()[:6]) >> 2


def record_id(source: int | None, mark: int = 0) -> str:
    """A version-8 (custom) UUID that carries the 64-bit source id and a mark; null has a variant of its own."""
    n = (source or 0) & (1 << 64) - 1
    high = (n >> 16) << 80 | 8 << 76 | (1 if source is None else 0) << 64
    return f"urn:uuid:{uuid.UUID(int=high | 2 << 62 | (n & 0xFFFF) << 46 | mark)}"


def source_of(urn: str) -> int | None:
    x = uuid.UUID(urn.removeprefix("<").removesuffix(">").removeprefix("urn:uuid:")).int
    if x >> 64 & 1:
        return None
    n = (x >> 80) << 16 | x >> 46 & 0xFFFF
    return n - (1 << 64) if n >> 63 else n


def _head(content: bytes) -> int:
    """Length of the HTTP head of an ARC record's content; 0 if it has none."""
    if not content.startswith(b"HTTP/"):
        return 0
    end = content.find(b"\r\n\r\n")
    return len(content) if end < 0 else end + 4


def to_warc(record: ArcRecord, source: int | None, mark: int = 0, refers_to: tuple[int, int] | None = None) -> bytes:
    """One WARC record: response, revisit (head only; refers_to: source id and mark of the first), or resource where the content is no HTTP message."""
    cut, revisit = _head(record.content), refers_to is not None
    payload, d = record.content[cut:], record.fields["date"].ljust(14, "0")
    block = record.content[:cut] if revisit else record.content
    kind = "revisit" if revisit else "response" if cut else "resource"
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id(source, mark)}>", f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        f"WARC-Target-URI: {record.fields['url']}", f"WARC-IP-Address: {record.fields['ip']}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"X-Payload-Length: {len(payload)}", f"Content-Type: {'application/http; msgtype=response' if cut else record.fields['type']}", f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines.insert(2, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.insert(3, f"WARC-Refers-To: <{record_id(*refers_to)}>")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_warc(stream) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of every record."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        yield headers, block


def source_id(record: ArcRecord) -> int | None:
    """The id in the HTTP head of a record; None if it has none."""
    found = re.search(rf"\r\n{SOURCE_HEADER}: (-?\d+)\r\n".encode(), record.content[: _head(record.content)])
    return int(found[1]) if found else None


def page_to_arc(version: int, page_id: int | None, url: str | None, html: bytes | None, offset: int = 0) -> bytes:
    body = html or b""
    own = "" if page_id is None else f"{SOURCE_HEADER}: {page_id}\r\n"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(body)}\r\n\r\n".encode()
    n = page_id or 0
    stamp = f"202401{1 + n // 86400 % 28:02d}{n // 3600 % 24:02d}{n // 60 % 60:02d}{n % 60:02d}"
    return arc_record(version, url or "", stamp, "text/html", head + body, offset)


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(1, wbits=31)
    return z.compress(data) + z.flush()


def write_arc(pages: DataFrame, uri: str | None = None, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> tuple[str, DataFrame]:
    """Pages as gzipped ARC files, one gzip member a record, of both versions (ids of even numbers: 1); (folder URI, table of file and n).

    Null bodies are empty, null URLs are "-", null ids write no id. Repeated rows are records of their own.
    """
    uri = uri or scratch_path(pages.sparkSession, "arc")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(body_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outs = {v: [RollingWriter(uri, ".arc.gz"), 0] for v in (1, 2)}
        made = []

        def roll(out: list) -> None:
            if name := out[0].roll():
                made.append((name, out[1]))
            out[1] = 0

        for b in slices(batches, "html"):
            for page, url, html in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), blobs(b.column("html")), strict=True):
                version = 1 + (page or 0) % 2
                out = outs[version]
                if not out[1]:
                    out[0].write(_member(arc_version_block(version)))
                out[0].write(_member(page_to_arc(version, page, url, html, out[0].size)))
                out[1] += 1
                if out[0].full:
                    roll(out)
        for out in outs.values():
            roll(out)
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], ["file", "n"])

    return uri, written(rows.mapInArrow(run, "file string, n long"), "arc-files")


def _records(uri: str, name: str) -> Iterator[ArcRecord]:
    with open_file(uri, name) as raw, gzip.GzipFile(fileobj=raw) as members:
        yield from read_arc(io.BufferedReader(members))


def payload_keys(uri: str, arcs: DataFrame) -> DataFrame:
    """file, k (number in the file), source, mark, sha (of the payload), size of every ARC record."""
    schema = "file string, k long, source long, mark long, sha binary, size long"
    arrow = plain(schema)

    def rows(batches) -> Iterator[tuple]:
        for b in batches:
            for name in b.column("file").to_pylist():
                for k, record in enumerate(_records(uri, name)):
                    payload = memoryview(record.content)[_head(record.content) :]
                    yield 100, (name, k, source_id(record), place_mark(name, k), hashlib.sha1(payload).digest(), len(payload))

    return spread(arcs).mapInArrow(lambda batches: batches_of(rows(batches), arrow), schema)


def write_archives(pages: DataFrame, uri: str | None = None, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_revisit_bytes: int = 0) -> tuple[str, DataFrame]:
    """Pages as ARC files, and those converted into gzipped WARC files; (folder URI, table of file and n).

    Null bodies are empty; null ids count as smaller than all others. Ties of the largest id (repeated rows) are all
    responses. Pages of any size are records of their own. An empty table writes no file.
    """
    spark = pages.sparkSession
    uri = uri or scratch_path(spark, "warc")
    arc_uri, arcs = write_arc(pages, None, id_col, url_col, body_col)
    keys = written(payload_keys(arc_uri, arcs), "payloads")
    # one row per payload that repeats; partial sums make a hot payload one row per task before it is shuffled
    firsts = keys.where(F.col("size") >= min_revisit_bytes).groupBy("sha").agg(F.max(F.when(F.col("source").isNotNull(), F.struct("source", "mark"))).alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    # AQE splits the hot payloads of this join: the other side has one row for each
    again = keys.join(written(firsts, "firsts"), "sha").where("first is not null and (source is null or source <> first.source)")
    again = again.groupBy("file").agg(F.collect_list("k").alias("ks"), F.collect_list("first").alias("firsts"))  # at most the records of one file
    work = written(arcs.join(again, "file", "left").select("file", "n", "ks", "firsts"), "conversions")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, made, n = RollingWriter(uri, ".warc.gz"), [], 0
        for b in batches:
            for row in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                revisits = {k: (f["source"], f["mark"]) for k, f in zip(row["ks"] or [], row["firsts"] or [], strict=True)}
                for k, record in enumerate(_records(arc_uri, row["file"])):
                    out.write(_member(to_warc(record, source_id(record), place_mark(row["file"], k), revisits.get(k))))
                    n += 1
                    if out.full:
                        made.append((out.roll(), n))
                        n = 0
        if n:
            made.append((out.roll(), n))
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], ["file", "n"])

    return uri, written(spread(work).mapInArrow(run, "file string, n long"), "warc-files")


def read_archives(uri: str, files: DataFrame) -> DataFrame:
    """One row per record of the listed files: page_id, payload_bytes, payload_digest, record_type, refers_to, url, date, and payload (null for revisits).

    A payload that does not match its digest or its length is an error. Files that are not listed are not read.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, date string, payload binary"
    arrow = plain(schema)

    def row(headers: dict, block: bytes) -> tuple:
        revisit, cut = headers["warc-type"] == "revisit", _head(block)
        payload = None if revisit else block[cut:]
        digest = headers["warc-payload-digest"].removeprefix("sha1:")
        if payload is not None and (len(payload) != int(headers["x-payload-length"]) or base32_sha1(payload) != digest):
            raise ValueError(f"payload of {headers['warc-record-id']} does not match its digest")
        return source_of(headers["warc-record-id"]), int(headers["x-payload-length"]), digest, headers["warc-type"], source_of(headers["warc-refers-to"]) if revisit else None, headers["warc-target-uri"], headers["warc-date"], payload

    def rows(batches) -> Iterator[tuple]:
        for b in batches:
            for name in b.column("file").to_pylist():
                with open_file(uri, name) as raw, gzip.GzipFile(fileobj=raw) as members:
                    for headers, block in read_warc(io.BufferedReader(members)):
                        yield len(block), row(headers, block)

    return spread(files).mapInArrow(lambda batches: batches_of(rows(batches), arrow), schema)


def op4_warc(spark, sf_dir: str) -> DataFrame:
    uri, files = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archives(uri, files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, h, strlen(h) AS n, unhex(sha1(h))::BIT::VARCHAR AS bits, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, n AS payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, i * 5 + 1, 1)::INT + 8 * substr(bits, i * 5 + 2, 1)::INT + 4 * substr(bits, i * 5 + 3, 1)::INT + 2 * substr(bits, i * 5 + 4, 1)::INT + substr(bits, i * 5 + 5, 1)::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM d
"""
