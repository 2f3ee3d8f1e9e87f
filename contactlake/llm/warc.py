"""Web archives: pages as legacy ARC files, ARC files converted to WARC, WARC files read back.

An ARC file starts with a ``filedesc:`` record whose body tells the version and
names the fields of all header lines: five in version 1, ten in version 2. Each
record is such a line and as many bytes as the line declares. The converter
reads lines and lengths, never searches payloads, and makes up what WARC wants
and ARC lacks: record ids, ISO dates, record types and digests.

Archives are whole files of about ``FILE_BYTES``. A file is one row while it is
written or read, so a task holds one file and its largest record at a time.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from contactlake.operators.skew import attach_facts
from contactlake.session import Scratch

#: bytes of records, before compression, after which a file ends
FILE_BYTES = 16 << 20
#: so many revisits are broadcast, about 300 bytes each
MAX_BROADCAST = 50_000
#: shorter payloads always stay responses
MIN_REVISIT_BYTES = 1000
#: the capture time of pages that bring none
CAPTURED = "20260101000000"

# The header fields of both ARC versions.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: (
        "URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset",
        "Filename", "Archive-length",
    ),
}
# Names and marks of the WARC format.
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_END = "\r\n\r\n"
CRLF = b"\r\n"

#: a page's key travels in a header of the captured response
PAGE_HEADER = "X-Page-Id"
#: and that of the page a revisit refers to in an extension field of its record
REFERS_HEADER = "X-Refers-To-Page-Id"
#: names under which record ids are made up
_IDS = uuid.uuid5(uuid.NAMESPACE_URL, "urn:contactlake:archives")


class ArchiveError(ValueError):
    """An archive that does not keep its format, with its place."""


@dataclass(frozen=True)
class Captured:
    """One record of an archive: where it stood, what its header says, and its body."""

    offset: int
    url: str
    date: str
    ip: str
    mime: str
    body: bytes
    kind: str = ""
    headers: dict[str, str] | None = None

    def split(self) -> tuple[bytes, bytes]:
        """The HTTP header block, its blank line included, and the payload; others are payload only."""
        if self.body.startswith(b"HTTP/") and (end := re.search(rb"\r?\n\r?\n", self.body)):
            return self.body[: end.end()], self.body[end.end() :]
        return b"", self.body


def header_value(head: bytes, name: str) -> str | None:
    """A field of an HTTP header block."""
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("latin-1").strip() if found else None


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def digest_of(label: str) -> str | None:
    """The lower-case hex SHA-1 of a digest field, in base 32 or hex; None: no such field."""
    kind, _, value = label.partition(":")
    if kind.lower() != "sha1":
        return None
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def _stream(content: bytes) -> io.BufferedIOBase:
    """An archive's bytes, unpacked if they are gzip members (one for all records, or one each)."""
    return gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


# -- ARC ---------------------------------------------------------------------------


def safe_url(url: str | None) -> str:
    """A URL that fits a header line: white space and control characters are percent-encoded; none is ``-``."""
    return re.sub(r"[\x00-\x20\x7F-\xA0]|\s", lambda c: "".join(f"%{b:02X}" for b in c[0].encode()), url or "") or "-"


def arc_head(name: str, version: int, date: str = CAPTURED) -> bytes:
    """The first record of an ARC file."""
    body = f"{version} 0 contactlake\n{' '.join(ARC_FIELDS[version])}\n".encode()
    return arc_record(version, f"filedesc://{name}", date, "text/plain", body, ip="0.0.0.0")


def arc_record(
    version: int, url: str, date: str, mime: str, body: bytes, ip: str = "0.0.0.0", status: int = 200, name: str = "-",
) -> bytes:
    known = {
        "URL": url, "IP-address": ip, "Archive-date": date, "Content-type": mime, "Result-code": str(status),
        "Checksum": hashlib.md5(body).hexdigest(), "Location": "-", "Offset": "0", "Filename": name,
        "Archive-length": str(len(body)),
    }
    return " ".join(known[f] for f in ARC_FIELDS[version]).encode() + b"\n" + body + b"\n"


def http_response(payload: bytes, page: int | str | None) -> bytes:
    own = f"{PAGE_HEADER}: {page}\r\n" if page is not None else ""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{own}\r\n"
    return head.encode() + payload


def read_arc(content: bytes, name: str = "") -> Iterator[Captured]:
    """The records of an ARC file after its first one, by their declared lengths.

    The version block decides how header lines are cut; they are cut from the
    right, so a URL may hold blanks. A file that does not keep the format
    raises ``ArchiveError`` with the place.
    """
    stream, fields, offset = _stream(content), None, 0
    while line := stream.readline():
        at, offset = offset, offset + len(line)
        if not line.strip():
            continue  # records are parted by a line break
        if fields is None:
            # the first header line tells itself apart by its number of fields
            cells = line.decode("utf-8", "replace").split()
            version = 2 if len(cells) == len(ARC_FIELDS[2]) else 1
            if len(cells) != len(ARC_FIELDS[version]) or not cells[0].startswith("filedesc:"):
                raise ArchiveError(f"{name}: no ARC version block")
        else:
            cells = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(fields) - 1)
            if len(cells) != len(fields):
                raise ArchiveError(f"{name}: no header line at byte {at}: {line[:80]!r}")
        try:
            size = int(cells[-1])
        except ValueError:
            raise ArchiveError(f"{name}: no length in the header line at byte {at}: {line[:80]!r}") from None
        body = stream.read(size)
        offset += len(body)
        if len(body) < size:
            raise ArchiveError(f"{name}: {size} bytes declared at byte {at}, {len(body)} found")
        if fields is None:
            lines = body.decode("utf-8", "replace").splitlines()
            version = int(lines[0].split()[0]) if lines and lines[0].split() and lines[0].split()[0].isdigit() else 0
            if version not in ARC_FIELDS:
                raise ArchiveError(f"{name}: unknown ARC version {lines[:1]}")
            fields = tuple(lines[1].split()) if len(lines) > 1 and lines[1].split() else ARC_FIELDS[version]
            continue
        known = dict(zip(fields, cells))
        yield Captured(
            at, known.get("URL", "-"), known.get("Archive-date", ""), known.get("IP-address", ""),
            known.get("Content-type", ""), body,
        )


# -- WARC --------------------------------------------------------------------------


def iso_date(arc_date: str) -> str:
    """An ARC date of 8 to 14 digits as WARC writes it; missing digits are those of the first instant."""
    digits = re.sub(r"[^0-9]", "", arc_date)
    filled = (digits + "00000101000000"[len(digits) :])[:14] if len(digits) >= 4 else CAPTURED
    return "{}-{}-{}T{}:{}:{}Z".format(filled[:4], *(filled[i : i + 2] for i in (4, 6, 8, 10, 12)))


def record_id(name: str, offset: int, url: str, date: str) -> str:
    """The same record of the same file always gets the same id."""
    return f"<urn:uuid:{uuid.uuid5(_IDS, f'{name}|{offset}|{url}|{date}')}>"


def warc_record(fields: Iterable[tuple[str, str | None]], block: bytes) -> bytes:
    head = [WARC_VERSION, *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + RECORD_END.encode()


def warc_info(name: str, date: str = CAPTURED) -> bytes:
    block = b"software: contactlake\r\nformat: WARC File Format 1.1\r\n"
    return warc_record(
        [
            ("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name, -1, "warcinfo", date)),
            ("WARC-Date", iso_date(date)), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"),
        ],
        block,
    )


@dataclass(frozen=True)
class Original:
    """The response that a revisit refers to."""

    record: str
    url: str
    date: str
    page: str | None


def convert_record(name: str, record: Captured, original: Original | None) -> bytes:
    """The WARC record of an ARC record: a revisit of ``original``, or the whole capture."""
    head, payload = record.split()
    shared = [
        ("WARC-Record-ID", record_id(name, record.offset, record.url, record.date)),
        ("WARC-Target-URI", record.url),
        ("WARC-Date", iso_date(record.date)),
        ("WARC-IP-Address", record.ip if record.ip not in ("", "-", "0.0.0.0") else None),
        ("WARC-Payload-Digest", sha1_label(payload)),
    ]
    if original is not None:
        # the response's header block stays; the payload is that of the other record
        return warc_record(
            [
                ("WARC-Type", "revisit"), *shared, ("WARC-Block-Digest", sha1_label(head)),
                ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", original.record),
                ("WARC-Refers-To-Target-URI", original.url), ("WARC-Refers-To-Date", iso_date(original.date)),
                (REFERS_HEADER, original.page), ("Content-Type", "application/http; msgtype=response"),
            ],
            head,
        )
    mime = record.mime if record.mime not in ("", "-", "no-type") else "application/octet-stream"
    kind = "response" if head or record.url.lower().startswith("dns:") else "resource"
    return warc_record(
        [
            ("WARC-Type", kind), *shared, ("WARC-Block-Digest", sha1_label(record.body)),
            ("Content-Type", "application/http; msgtype=response" if head else mime),
        ],
        record.body,
    )


def read_warc(content: bytes, name: str = "") -> Iterator[Captured]:
    """The records of a WARC file, by their declared lengths."""
    stream, offset = _stream(content), 0
    while line := stream.readline():
        at, offset = offset, offset + len(line)
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ArchiveError(f"{name}: no record at byte {at}: {line[:80]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            offset += len(line)
            key, _, value = line.decode("utf-8", "replace").partition(":")
            headers[key.strip().lower()] = value.strip()
        offset += len(line)
        size = int(headers.get("content-length", "-1"))
        body = stream.read(max(size, 0))
        offset += len(body)
        if size < 0 or len(body) < size:
            raise ArchiveError(f"{name}: {size} bytes declared at byte {at}, {len(body)} found")
        yield Captured(
            at, headers.get("warc-target-uri", ""), headers.get("warc-date", ""),
            headers.get("warc-ip-address", ""), headers.get("content-type", ""), body, headers["warc-type"], headers,
        )


# -- jobs --------------------------------------------------------------------------


def _save(files: DataFrame, path: str, end: str) -> None:
    """One file per row of ``content``. Spark's text writer puts the bytes out as they are, then ``end``."""
    options = {"lineSep": end, "compression": "gzip", "maxRecordsPerFile": 1}
    files.select(F.col("content").cast("string").alias("value")).write.options(**options).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """``(name, content)``; names end with the file's own name, and tell part files apart."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return found.select(F.substring_index("path", "/", -1).alias("name"), "content")


def write_arc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Each page as a captured response in gzipped ARC files, which take the two versions in turn.

    A null html is an empty payload, a null url is ``-``, a null key leaves the
    response without its key header; blanks in a url are percent-encoded.
    Repeated rows become repeated records. An empty table gives no file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["content"])

        for batch in batches:
            for page, place, text in zip(*(batch.column(i) for i in range(3))):
                if not held:
                    version = 1 + number % 2
                    held.append(arc_head(f"pages-{number}.arc", version))
                body = http_response((text.as_py() or "").encode(), page.as_py())
                held.append(arc_record(version, safe_url(place.as_py()), CAPTURED, "text/html", body))
                size += len(body)
                if size >= FILE_BYTES:
                    yield flush()
                    held, size, number = [], 0, number + 1
        if held:
            yield flush()

    rows = pages.select(F.col(key), F.col(url).cast("string"), F.col(html).cast("string"))
    _save(rows.mapInArrow(write, "content binary"), path, "\n")


def index_arc(spark: SparkSession, path: str) -> DataFrame:
    """Per record of ARC files ``(name, offset, url, date, page, is_http, payload_bytes, payload_sha1)``, without payloads."""
    schema = "name string, offset bigint, url string, date string, page string, is_http boolean, payload_bytes bigint, payload_sha1 string"

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows = []
                for r in read_arc(content.as_py(), name.as_py()):
                    head, payload = r.split()
                    sha1 = hashlib.sha1(payload).hexdigest()
                    rows.append((name.as_py(), r.offset, r.url, r.date, header_value(head, PAGE_HEADER), bool(head), len(payload), sha1))
                columns = list(zip(*rows)) or [[]] * 8
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds)],
                    names=["name", "offset", "url", "date", "page", "is_http", "payload_bytes", "payload_sha1"],
                )

    return _files(spark, path).mapInArrow(index, schema)


def _order(page: str = "page") -> Column:
    """Pages by number, others by name; of equal ones the later place."""
    return F.struct(F.col(page).try_cast("bigint"), page, "name", "offset")


def find_revisits(index: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``(name, offset, original)`` of the responses whose payload another one, of the largest page, keeps.

    Digests of one record only are left out by an aggregate with map-side
    combine; the groups that remain are joined back, a hot one without a shuffle.
    """
    long = index.filter(F.col("is_http") & (F.col("payload_bytes") >= min_bytes))
    same = ["payload_sha1", "payload_bytes"]
    kept = (
        long.groupBy(*same)
        .agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("name", "offset", "url", "date", "page"), _order()).alias("original"))
        .filter("n > 1")
    )
    others = attach_facts(long.select(*same, "name", "offset"), kept, same, "n", index.count())
    itself = (F.col("name") == F.col("original.name")) & (F.col("offset") == F.col("original.offset"))
    return others.filter(~itself).select("name", "offset", "original")


def convert(
    spark: SparkSession, arc: str, warc: str, index: DataFrame | None = None, min_bytes: int = MIN_REVISIT_BYTES
) -> None:
    """ARC files under ``arc`` as WARC files under ``warc``, one for one.

    ``index`` (``index_arc``, stored) spares a second reading of the payloads.
    The list of a file's revisits is joined to it: up to ``MAX_BROADCAST``
    revisits are broadcast, and payloads stay in the task that reads them; with
    more, files and lists are dealt by name, about one file to a task.
    """
    scratch = Scratch(spark, "convert")
    index = scratch.put("index", index_arc(spark, arc)) if index is None else index
    found = scratch.put("revisits", find_revisits(index, min_bytes))
    revisits = found.groupBy("name").agg(
        F.collect_list(F.struct("offset", "original")).alias("revisits")  # at most the records of one file
    )
    files = _files(spark, arc)
    if found.count() <= MAX_BROADCAST:
        files = files.join(F.broadcast(revisits), "name", "left")
    else:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), index.select("name").distinct().count())
        files = files.repartition(parts, "name").join(revisits.repartition(parts, "name"), "name", "left")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, revisits in zip(*(batch.column(i) for i in range(3))):
                name = name.as_py()
                known = {
                    r["offset"]: Original(
                        record_id(o["name"], o["offset"], o["url"], o["date"]), o["url"], o["date"], o["page"]
                    )
                    for r in revisits.as_py() or ()
                    for o in [r["original"]]
                }
                out = [warc_info(re.sub(r"\.gz$", "", name) + ".warc.gz")]
                out += [convert_record(name, r, known.get(r.offset)) for r in read_arc(content.as_py(), name)]
                whole = b"".join(out)[: -len(RECORD_END)]
                yield pa.RecordBatch.from_arrays([pa.array([whole], pa.binary())], names=["content"])

    _save(files.select("name", "content", "revisits").mapInArrow(rewrite, "content binary"), warc, RECORD_END)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The captures of WARC files: ``(page, url, date, record_type, payload, payload_bytes, payload_sha1, refers_to, record_id)``.

    Digest and length are those of the full payload: a revisit's come from its
    fields and its response headers. A response whose payload does not have the
    digest of its record raises ``ArchiveError``.
    """
    names = ["page", "url", "date", "record_type", "payload", "payload_bytes", "payload_sha1", "refers_to", "record_id"]
    text = pa.string()
    kinds = (text, text, text, text, pa.binary(), pa.int64(), text, text, text)
    schema = ", ".join(f"{n} {'binary' if n == 'payload' else 'bigint' if n == 'payload_bytes' else 'string'}" for n in names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows, size = [], 0

                def flush() -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

                for r in read_warc(content.as_py(), name.as_py()):
                    if r.kind == "warcinfo":
                        continue
                    head, payload = r.split()
                    sha1 = digest_of(r.headers.get("warc-payload-digest", ""))
                    if r.kind == "revisit":
                        n, payload = int(header_value(r.body, "Content-Length") or 0), None
                    else:
                        n, found = len(payload), hashlib.sha1(payload).hexdigest()
                        if (sha1 := sha1 or found) != found:
                            raise ArchiveError(f"{name}: another payload than declared at byte {r.offset}")
                    page = header_value(r.body if r.kind == "revisit" else head, PAGE_HEADER)
                    rows.append(
                        (page, r.url, r.date, r.kind, payload, n, sha1, r.headers.get(REFERS_HEADER.lower()), r.headers["warc-record-id"])
                    )
                    size += len(payload or b"")
                    if size > FILE_BYTES // 4:
                        yield flush()
                        rows, size = [], 0
                if rows:
                    yield flush()

    return _files(spark, path).mapInArrow(read, schema)
