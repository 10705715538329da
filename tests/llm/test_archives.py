import base64
import hashlib
import io

import pytest

from tests.llm.cases import by
from tradewind.llm import archives
from tradewind.llm.shared import shared_folder

PAGES = "page_id long, url string, html string, digest string, path string, n int"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    rows = [(3, "http://a/ b\n", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "", None), (7, "http://x", ""), (5, "dns:x", "http\r\n\r\n200 \x00"), (None, "u", "<p>é</p>"), (None, "u", "only"), (9, "u", "x" * 300_000), (9, "u", "x" * 300_000), (8, "u", "last"), (6, "u", "abcd"), (4, "u", "abcd")]
    pages = spark.createDataFrame([(*r, "d", "p", 1) for r in rows], PAGES).repartition(3)
    folder = shared_folder(spark, "a")
    warcs = archives.convert(spark, archives.write_arc(pages, folder), folder, least_bytes=least)
    got = archives.records(warcs).collect()
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    expected = []
    for page, _, html in rows:
        n, smallest = len((html or "").encode()), first.get(html or "")
        revisit = n >= least and smallest is not None and smallest != page
        expected.append((page, n, digest(html), "revisit" if revisit else "response", smallest if revisit else None))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert by(got, *names) == by([dict(zip(names, e)) for e in expected], *names)
    assert len({r["record_id"] for r in got}) == len(rows)  # repeated pages are records of their own


def test_no_pages(spark):
    folder = shared_folder(spark, "a")
    warcs = archives.convert(spark, archives.write_arc(spark.createDataFrame([], PAGES), folder), folder)
    assert archives.records(warcs).collect() == []


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions_and_types(version):
    line = lambda url, body, kind="text/plain": archives.arc_line(version, url, "1.2.3.4", "199609181234", kind, len(body)) + body + b"\n"
    raw = archives.arc_head(version, "f.arc", "19960918123456") + line("dns:a", b"a 1\n\nb") + line("http://a/with blank", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\npay\n") + line("ftp://x", b"")
    records = list(archives.read_arc(io.BufferedReader(io.BytesIO(raw))))
    assert [(r.number, r.url, r.body) for r in records[1:]] == [(1, "dns:a", b"a 1\n\nb"), (2, "http://a/with blank", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\npay\n"), (3, "ftp://x", b"")]
    warc = b"".join(b"".join(archives.converted(r, "f.arc", None)) for r in records)
    fields = [f for f, _ in archives.read_warc(io.BufferedReader(io.BytesIO(warc)))]
    assert [f["WARC-Type"] for f in fields] == ["warcinfo", "resource", "response", "resource"]
    assert [f["Content-Type"] for f in fields][1:] == ["text/dns", "application/http; msgtype=response", "text/plain"]
    assert fields[1]["WARC-Date"] == "1996-09-18T12:34:00Z"
    assert len({f["WARC-Record-ID"] for f in fields}) == 4


def test_short_archive_is_refused():
    raw = archives.arc_head(1, "f", "19960918123456") + b"http://a 0 1 t 10\nabc"
    with pytest.raises(ValueError, match="early"):
        list(archives.read_arc(io.BufferedReader(io.BytesIO(raw))))
