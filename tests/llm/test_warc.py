"""Legacy archives: written, converted and read back."""

import gzip
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from contactlake.llm import warc
from contactlake.session import Scratch

SCHEMA = "page_id bigint, url string, html string, page string, offset string, n string, original string"


def arc(version, records, date="20010203040506"):
    out = warc.arc_head("old.arc", version, date)
    return out + b"".join(warc.arc_record(version, u, date, "text/html", b) for u, b in records)


@pytest.mark.parametrize("version", [1, 2])
def test_headers_are_cut_by_version_and_bodies_by_length(version):
    bodies = [b"", b"http://x 1.2.3.4 20010101000000 text/html 5\nhello", "é\r\n\r\nWARC/1.0".encode(), b"\n\n\n"]
    found = list(warc.read_arc(arc(version, [(f"http://a/{i} b", b) for i, b in enumerate(bodies)])))
    assert [r.body for r in found] == bodies
    assert [r.url for r in found] == [f"http://a/{i} b" for i in range(4)]  # blanks stay in the URL
    packed = b"".join(gzip.compress(part) for part in re.split(rb"(?=http://a/)", arc(version, [("http://a/1", b"x")])))
    assert [r.body for r in warc.read_arc(packed)] == [b"x"]  # one gzip member per record


def test_damaged_archives_name_the_place():
    good = arc(1, [("http://a", b"body")])
    with pytest.raises(warc.ArchiveError, match="no ARC version block"):
        list(warc.read_arc(b"hello\n"))
    with pytest.raises(warc.ArchiveError, match="4 bytes declared at byte"):
        list(warc.read_arc(good[:-4]))
    with pytest.raises(warc.ArchiveError, match="no header line at byte"):
        list(warc.read_arc(good + b"junk\n"))
    with pytest.raises(warc.ArchiveError, match="unknown ARC version"):
        list(warc.read_arc(good.replace(b"\n1 0 ", b"\n7 0 ")))


def test_synthesised_fields():
    assert warc.iso_date("20010203040506") == "2001-02-03T04:05:06Z"
    assert warc.iso_date("200102030405") == "2001-02-03T04:05:00Z" and warc.iso_date("2001") == "2001-01-01T00:00:00Z"
    assert warc.record_id("f", 1, "u", "d") == warc.record_id("f", 1, "u", "d") != warc.record_id("f", 2, "u", "d")
    body = b"HTTP/1.0 200 OK\nServer: old\n\npayload"
    (record,) = warc.read_warc(warc.convert_record("f", warc.Captured(3, "http://a", "20010203", "1.2.3.4", "text/html", body), None))
    fields = record.headers
    assert (record.kind, record.body, fields["warc-ip-address"]) == ("response", body, "1.2.3.4")
    assert warc.digest_of(fields["warc-payload-digest"]) == hashlib.sha1(b"payload").hexdigest()
    assert warc.digest_of(fields["warc-block-digest"]) == hashlib.sha1(body).hexdigest()
    (other,) = warc.read_warc(warc.convert_record("f", warc.Captured(3, "ftp://a", "20010203", "", "no-type", b"x"), None))
    assert (other.kind, other.mime) == ("resource", "application/octet-stream")


def brute(rows):
    payloads = [(page, (html or "").encode()) for page, _, html in rows]
    out = []
    for page, data in payloads:
        same = [p for p, d in payloads if d == data]
        largest = max((p for p in same if p is not None), default=None)
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), len(data) >= 1000 and len(same) > 1, largest))
    return out


def pages():
    long = "<p>é 😀</p>" * 400
    rows = [(i, f"http://h/{i}", f"<html>{i}</html>") for i in range(30)]
    rows += [(100 + i, "http://copy", long) for i in range(12)]
    rows += [(200 + i, "http://short", "s" * 999) for i in range(3)] + [(300 + i, None, "t" * 1000) for i in range(2)]
    rows += [(None, "a b\n c", long), (None, "", None), (400, "x", ""), (401, "x", "\r\n\r\nWARC/1.1\r\nHTTP/1.1 200 OK\r\n\r\n")]
    return rows + [(402, "dns:h", "big" * 200_000), (403, "x", "big" * 200_000)]


def archived(spark, rows, size):
    df = spark.createDataFrame([(*r, "p", "o", "n", "r") for r in rows], SCHEMA)
    scratch = Scratch(spark, "warc")
    warc.write_arc(df, scratch.path("arc"))
    warc.convert(spark, scratch.path("arc"), scratch.path("warc"), scratch.put("index", warc.index_arc(spark, scratch.path("arc"))))
    return warc.read_archive(spark, scratch.path("warc")).collect()


@pytest.mark.parametrize("size", [2_000, 16 << 20])
def test_round_trip_and_revisits(spark, monkeypatch, size):
    monkeypatch.setattr(warc, "FILE_BYTES", size)  # a few records a file, or all
    rows = pages()
    got = archived(spark, rows, size)
    want = brute(rows)
    key = lambda r: (str(r[0]), r[1:3])
    assert sorted(((int(r.page) if r.page else None, r.payload_bytes, r.payload_sha1) for r in got), key=key) == sorted(
        (w[:3] for w in want), key=key
    )
    by_page = {int(r.page): r for r in got if r.page}
    for page, _, _, repeated, largest in want:
        if page is not None:
            revisit = repeated and page != largest
            assert (by_page[page].record_type == "revisit", by_page[page].refers_to) == (revisit, str(largest) if revisit else None)
    texts = {p: h for p, _, h in rows if p is not None}
    assert all(r.payload is None or bytes(r.payload).decode() == texts[int(r.page)] for r in got if r.page)
    assert len({r.record_id for r in got}) == len(rows)


def test_equal_keys_and_equal_payloads(spark):
    got = archived(spark, [(1, "http://a", "y" * 1500)] * 3, 0)
    assert sorted(r.record_type for r in got) == ["response", "revisit", "revisit"]
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {"1"}


def test_empty_table(spark):
    assert archived(spark, [], 0) == []


def test_another_payload_than_declared_is_an_error(spark, tmp_path):
    record = warc.convert_record("f", warc.Captured(0, "http://a", "2001", "", "", b"HTTP/1.0 200 OK\n\nbody"), None)
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record.replace(b"\n\nbody", b"\n\nBODY")))
    with pytest.raises(Exception, match="another payload than declared"):
        warc.read_archive(spark, str(tmp_path)).select(F.count("page")).collect()
