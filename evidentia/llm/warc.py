"""Legacy ARC archives converted to WARC.

An ARC file starts with a version block, which says how its record headers read: version 1 has
five fields, version 2 ten.  Fields are split off from the right, as old crawlers left spaces in
URLs, and a record's content is taken by its declared length, never by looking for the next
header.  Conversion adds what WARC wants and ARC lacks: record identifiers (from the archive's path
and the record's offset), ISO timestamps, record types and digests.  Content with an HTTP header is
a response; content without one (dns:, ftp:, ...) is a resource of the header's type.  Of responses
with equal payloads the one with the largest page id, then path and offset, stays a response; the
others become revisits that refer to it and carry their HTTP header alone.

Pages are archived where they lie, by Spark's text writer, whose line separator is the format's own
record separator.  A task rolls on to a new gzip-compressed archive after a fixed size, so an
archive is bounded by that size and one record, however much a task is given, and archives are what
tasks read.  A digest has one row for each archive that holds it, so a payload that a third of
all pages share is no hot key; which records are revisits comes back to an archive as rows that
are no more than its own records.

Null html is an empty payload, a null URL an empty field ("-").  Page ids are whole numbers; null
ones count as the smallest and come back as null, as do pages of foreign archives, which name none.
Of rows that repeat both page id and payload one is the response.  Texts of any length are written
whole; other columns, whatever their names, aren't read; an empty table gives an empty result.
Archive dates may be cut short; what is no date at all becomes the epoch.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime
from urllib.parse import quote
from uuid import UUID, uuid4

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, new_path, utf8

#: Fields of an ARC record header, by version.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
STAMP = "20200101000000"
RECORD_END = "\r\n\r\n"
#: Bytes of records after which a row for the writer ends, and how many such rows an archive holds.
CHUNK, ARCHIVE_CHUNKS = 4 << 20, 8
LOWEST = -(1 << 63)


def sha1_32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(*place: object) -> str:
    """A URN made from where a record was found."""
    return f"<urn:uuid:{UUID(bytes=hashlib.sha1(repr(place).encode('utf-8', 'surrogateescape')).digest()[:16], version=5)}>"


def warc_date(stamp: str) -> str:
    """An ARC date of up to 14 digits in ISO form."""
    try:
        return datetime.strptime(stamp[:14] + "00010101000000"[len(stamp[:14]) :], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ").rjust(20, "0")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def arc_header(version: int, values: dict[str, str]) -> bytes:
    return " ".join(values.get(f, "-") for f in FIELDS[version]).encode()


def arc_version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 evidentia\n{' '.join(FIELDS[version])}\n".encode()
    return arc_header(version, {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": STAMP, "Content-type": "text/plain", "Archive-length": str(len(body))}) + b"\n" + body


def _inflated(content: bytes) -> bytes:
    """The file's bytes; gzip members are joined."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content[:2] == b"\x1f\x8b":
        stream = zlib.decompressobj(31)
        out.append(stream.decompress(content))
        content = stream.unused_data
    return b"".join(out)


def read_arc(content: bytes) -> Iterator[tuple[int, dict[str, str], memoryview]]:
    """Offset, header fields and content of each record but version blocks."""
    data, at, version = _inflated(content), 0, 1
    view = memoryview(data)
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "surrogateescape").rstrip("\r")
        if line.startswith("filedesc://"):
            version = int(data[end + 1 : end + 2])  # the block's first character
        values = line.rsplit(" ", len(FIELDS[version]) - 1)
        if len(values) != len(FIELDS[version]):
            raise ValueError(f"not an ARC {version} header: {line[:200]!r}")
        fields = dict(zip(FIELDS[version], values, strict=True))
        first, start, at = at, end + 1, end + 1 + int(fields["Archive-length"])
        if at > len(data):
            raise ValueError("a record is shorter than its header declares")
        if not line.startswith("filedesc://"):
            yield first, fields, view[start:at]


def http_parts(content: memoryview) -> tuple[bytes, dict[str, str], memoryview]:
    """Header bytes with their end, header fields in lower case, payload; no header: all is payload."""
    if bytes(content[:5]) != b"HTTP/":
        return b"", {}, content
    raw = bytes(content)
    ends = [(at, len(mark)) for mark in (b"\r\n\r\n", b"\n\n") if (at := raw.find(mark)) >= 0]
    if not ends:
        return b"", {}, content
    cut, width = min(ends)
    lines = raw[:cut].decode("latin-1").splitlines()[1:]
    return raw[: cut + width], {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, content[cut + width :]


def warc_record(kind: str, headers: dict[str, str], block: bytes | memoryview) -> bytes:
    lines = [f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return b"".join([b"WARC/1.1\r\n", "\r\n".join(lines).encode("utf-8", "surrogateescape"), b"\r\n\r\n", block])


def read_warc(content: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    data, at = _inflated(content), 0
    view = memoryview(data)
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8", "surrogateescape").split("\r\n")
        if not first.startswith("WARC/1."):
            raise ValueError(f"not a WARC record: {first[:200]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start, at = end + 4, end + 4 + int(headers["content-length"])
        yield headers, view[start:at]
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        at += 4


def _archived(records: Iterator[bytes], separator: str, opening: Callable[[int], bytes]) -> Iterator[pa.RecordBatch]:
    """Records in rows for the writer; every ARCHIVE_CHUNKS rows make an archive, which begins with opening(its number)."""
    part: list[bytes] = []
    rows = held = 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([separator.encode().join(part)], pa.binary())], ["value"])

    for record in records:
        if not part and rows % ARCHIVE_CHUNKS == 0:
            part.append(opening(rows // ARCHIVE_CHUNKS))
        part.append(record)
        held += len(record)
        if held >= CHUNK:
            yield row()
            part, held, rows = [], 0, rows + 1
    if part:
        yield row()


def _to_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    version = 1 + task % 2

    def records() -> Iterator[bytes]:
        for batch in batches:
            for key, url, html in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                page = "" if key is None else f"X-Page: {key}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{page}\r\n".encode()
                values = {"URL": quote(url or "-", safe="%/:=&?~#+!$,;'@()*[]"), "IP-address": "0.0.0.0", "Archive-date": STAMP, "Content-type": "text/html", "Result-code": "200", "Archive-length": str(len(head) + len(html))}
                yield b"".join([arc_header(version, values), b"\n", head, html])

    # the record separator stands for the end of the version block's last line
    return _archived(records(), "\n", lambda number: arc_version_block(version, f"pages-{task:06d}-{number:06d}.arc.gz").removesuffix(b"\n"))


def _write(df: DataFrame, path: str, separator: str) -> None:
    rows = df.select(F.col("value").cast("string").alias("value"))
    rows.write.option("lineSep", separator).option("compression", "gzip").option("maxRecordsPerFile", ARCHIVE_CHUNKS).text(path)


def _files(spark: SparkSession, path: str, names: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", names).load(path).select("path", "content")


def _page(fields: dict[str, str]) -> int | None:
    key = fields.get("x-page", "")
    return int(key) if key.removeprefix("-").isdecimal() else None


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each archive its payloads: where they are, and which of its records of that payload comes first."""
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
            for offset, _, block in read_arc(content):
                head, http, payload = http_parts(block)
                if head:
                    key = _page(http)
                    found.setdefault((len(payload), hashlib.sha1(payload).digest() + hashlib.sha256(payload).digest()), []).append((LOWEST if key is None else key, offset))
            best = [max(places) for places in found.values()]
            columns = [[path] * len(found), [k for k, _ in found], [d for _, d in found], [k for k, _ in best], [o for _, o in best], [[o for _, o in places] for places in found.values()]]
            kinds = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["path", "bytes", "digest", "key", "offset", "offsets"])


def _to_warc(job: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()

        def opening(number: int) -> bytes:
            headers = {"WARC-Record-ID": record_id(job, task, number), "WARC-Date": warc_date(STAMP), "Content-Type": "application/warc-fields"}
            return warc_record("warcinfo", headers, b"software: evidentia\r\nformat: WARC File Format 1.1\r\n")

        def records() -> Iterator[bytes]:
            for batch in batches:
                for path, content, refers in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    target = {o: (r["to_path"], r["to_offset"], r["to_key"]) for r in refers or [] for o in r["offsets"] if (path, o) != (r["to_path"], r["to_offset"])}
                    for offset, arc, block in read_arc(content):
                        head, http, payload = http_parts(block)
                        kind = "revisit" if offset in target else "response" if head else "resource"
                        headers = {"WARC-Record-ID": record_id(path, offset), "WARC-Date": warc_date(arc["Archive-date"]), "WARC-Target-URI": arc["URL"], "WARC-IP-Address": arc["IP-address"], "WARC-Payload-Digest": f"sha1:{sha1_32(payload)}"}
                        headers["Content-Type"] = "application/http;msgtype=response" if head else arc["Content-type"]
                        if _page(http) is not None:
                            headers["X-Page"] = str(_page(http))
                        if kind == "revisit":
                            *to, to_key = target[offset]
                            headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(*to), "X-Payload-Length": str(len(payload))}
                            if to_key is not None:
                                headers["X-Refers-To-Page"] = str(to_key)
                            block = head
                        headers["WARC-Block-Digest"] = f"sha1:{sha1_32(block)}"
                        yield warc_record(kind, headers, block)

        return _archived(records(), RECORD_END, opening)

    return run


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0).to_pylist():
            rows = []
            for headers, block in read_warc(content):
                if headers["warc-type"] == "warcinfo":
                    continue
                _, _, payload = http_parts(block)
                digest, revisit = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"] == "revisit"
                if not revisit and sha1_32(payload) != digest:
                    raise ValueError(f"the payload of {headers['warc-record-id']} doesn't have its digest")
                to = headers.get("x-refers-to-page")
                rows.append((_page(headers), int(headers["x-payload-length"]) if revisit else len(payload), digest, headers["warc-type"], None if to is None else int(to), headers["warc-target-uri"], headers["warc-record-id"], headers.get("warc-refers-to")))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id", "refers_to_id"])


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """gzip-compressed ARC files; tasks write versions 1 and 2 by turns."""
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("key"), F.col(f"`{url_col}`").alias("url"), utf8(F.col(f"`{html_col}`")).alias("html"))
    _write(arrow_map(rows, _to_arc, "value binary"), path, "\n")


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = 0, names: str = "*") -> None:
    """ARC files to WARC files.  min_bytes: smaller payloads are never revisits; names: a glob of file names."""
    files = _files(spark, arc_path, names)
    partitions = max(1, files.select("path").count())  # reads no content
    found = arrow_map(files, _digests, "path string, bytes long, digest binary, key long, offset long, offsets array<long>")
    best = found.filter(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(F.max(F.struct("key", "path", "offset")).alias("best"), F.sum(F.size("offsets")).alias("n"))
    best = best.filter("n > 1").select("digest", "bytes", F.col("best.path").alias("to_path"), F.col("best.offset").alias("to_offset"), F.nullif("best.key", F.lit(LOWEST)).alias("to_key"))
    by_file = found.join(best, ["digest", "bytes"]).groupBy("path").agg(F.collect_list(F.struct("offsets", "to_path", "to_offset", "to_key")).alias("refers"))
    # as many tasks as archives, so that a task holds a few of them at most
    joined = files.repartition(partitions, "path").join(by_file.repartition(partitions, "path"), "path", "left").select("path", "content", "refers")
    _write(arrow_map(joined, _to_warc(uuid4().hex), "value binary"), warc_path, RECORD_END)


def read_back(spark: SparkSession, warc_path: str) -> DataFrame:
    """One row per record but warcinfo: key, payload_bytes, payload_digest, record_type, refers_to, url, record_id, refers_to_id; digests are checked."""
    return arrow_map(_files(spark, warc_path).select("content"), _read_back, "key long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string, refers_to_id string")


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Pages through ARC to WARC files in the shared folder and back."""
    spark = pages.sparkSession
    arc_path, warc_path = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc_path, id_col, url_col, html_col)
    convert(spark, arc_path, warc_path, min_bytes)
    return read_back(spark, warc_path).select(F.col("key").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")
