"""Legacy ARC archives to WARC.

ARC has two header lines: version 1 gives URL, IP, date, type and length; version 2 puts result code, checksum, location,
offset and file name before the length. Which one holds is said by the file's first record, a ``filedesc``. A record's
body is as long as declared, whatever is in it. The converter reads the fields from the right, so that blanks in a broken
URL do no harm, and synthesises what WARC asks for besides: identifier, ISO date, type and digests.

=============  =======================================================
ARC record     WARC record
=============  =======================================================
``filedesc``   ``warcinfo``
HTTP response  ``response``, or ``revisit`` if an equal payload stands elsewhere
``dns:``       ``resource`` of type text/dns
others         ``resource`` of the declared type
=============  =======================================================

Equal payloads are found by digest over all archives; of each group the record with the smallest page id is the response. Null html: empty payload. Null page id:
written without one, revisits a group that has an id, else stays a response. Null or blank URL: ``urn:x-unknown``. Repeated
page ids: a record each. No pages: no archives. Files are written and read by tasks, one gzip member a record.
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
from dataclasses import dataclass
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm.shared import file_system, new_file, one_file_each, stored

MANIFEST = "path string, records long"
CAPTURES = "path string, number long, page_id long, payload_bytes long, payload_digest string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string"

# Fixed values of both formats.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

PAGE_HEADER = b"X-Page-Id"
# Payload bytes in an archive before the next one is begun.
ARCHIVE_BYTES = 256 << 20


def sha1_base32(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw, usedforsecurity=False).digest()).decode()


def urn(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


class MemberWriter:
    """A file of gzip members."""

    def __init__(self, folder: str, name: str, suffix: str):
        self.path = new_file(folder, name) + suffix
        fs, place = file_system(self.path)
        fs.create_dir(place.rpartition("/")[0], recursive=True)
        self.out, self.records, self.bytes = fs.open_output_stream(place, compression=None), 0, 0

    def add(self, *parts: bytes) -> None:
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        for p in parts:
            self.out.write(packer.compress(p))
            self.bytes += len(p)
        self.out.write(packer.flush())
        self.records += 1

    def close(self) -> tuple[str, int]:
        self.out.close()
        return self.path, self.records


def opened(path: str) -> io.BufferedReader:
    fs, place = file_system(path)
    return io.BufferedReader(gzip.GzipFile(fileobj=fs.open_input_stream(place, compression=None)), 1 << 18)


# ---- ARC -------------------------------------------------------------------------------------------------


@dataclass
class ArcRecord:
    number: int  # from 0, the filedesc
    url: str
    ip: str
    date: str
    kind: str
    body: bytes

    @property
    def http(self) -> tuple[bytes, bytes] | None:
        """Header lines and payload of an HTTP response."""
        if not self.body.startswith(b"HTTP/"):
            return None
        head, _, payload = self.body.partition(b"\r\n\r\n")
        return head, payload


def header_value(head: bytes, name: bytes) -> bytes | None:
    m = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*?)[ \t]*\r?$", head)
    return m[1] if m else None


def page_of(head: bytes) -> int | None:
    value = header_value(head, PAGE_HEADER)
    return int(value) if value else None


def arc_line(version: int, url: str, ip: str, date: str, kind: str, length: int, name: str = "-") -> bytes:
    middle = f" 200 - - 0 {name}" if version == 2 else ""
    return f"{url} {ip} {date} {kind}{middle} {length}\n".encode()


def arc_head(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 tradewind\n{FIELDS[version]}\n\n".encode()
    return arc_line(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", len(body), name) + body + b"\n"


def read_arc(stream: io.BufferedReader) -> Iterator[ArcRecord]:
    """Records in order, one in memory at a time."""
    version, number = None, 0
    while line := stream.readline():
        if line.strip() == b"":
            continue
        if version is None:
            length = int(line.rsplit(b" ", 1)[1])
            body = _exactly(stream, length)
            version = int(body.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version}")
            fields = line.decode("utf-8", "replace").rstrip("\n").rsplit(" ", len(FIELDS[version].split()) - 1)
        else:
            fields = line.decode("utf-8", "replace").rstrip("\n").rsplit(" ", len(FIELDS[version].split()) - 1)
            body = _exactly(stream, int(fields[-1]))
        yield ArcRecord(number, fields[0], fields[1], fields[2], fields[3], body)
        number += 1


def _exactly(stream: io.BufferedReader, length: int) -> bytes:
    body = stream.read(length)
    if len(body) != length:
        raise ValueError(f"archive ends {length - len(body)} bytes early")
    return body


def write_arc(pages: DataFrame, folder: str, date: str = "20240101000000") -> DataFrame:
    """ARC archives of (page_id, url, html), a task's share in files of its own; versions 1 and 2 in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, made = TaskContext.get().partitionId(), None, []
        version = 1 + part % 2
        for batch in batches:
            for page, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                if out is None:
                    out = MemberWriter(f"{folder}/arc", f"pages-{part:06d}", ".arc.gz")
                    out.add(arc_head(version, out.path.rpartition("/")[2], date))
                payload = (html or "").encode()
                marked = b"" if page is None else b"%b: %d\r\n" % (PAGE_HEADER, page)
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%bContent-Length: %d\r\n\r\n" % (marked, len(payload))
                name = quote(url or "", safe="!#$%&'()*+,/:;=?@[]~") or "urn:x-unknown"
                out.add(arc_line(version, name, "0.0.0.0", date, "text/html", len(head) + len(payload)), head, payload, b"\n")
                if out.bytes >= ARCHIVE_BYTES:
                    made.append(out.close())
                    out = None
        made += [out.close()] if out else []
        yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in made], pa.string()), "records": pa.array([n for _, n in made], pa.int64())})

    chosen = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return stored(chosen.mapInArrow(run, MANIFEST), f"{folder}/arc-manifest")


def captures(archives: DataFrame) -> DataFrame:
    """Each HTTP response of the archives with the digest of its payload."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path in part["path"]:
                rows = []
                with opened(path) as stream:
                    for r in read_arc(stream):
                        head, payload = r.http or (b"", r.body)
                        rows.append((path, r.number, page_of(head), len(payload), sha1_base32(payload) if r.http else None))
                out = pd.DataFrame(rows, columns=["path", "number", "page_id", "payload_bytes", "payload_digest"])
                yield out.astype({"page_id": "Int64", "number": "int64", "payload_bytes": "int64"})

    return one_file_each(archives, "path").mapInPandas(run, CAPTURES)


# ---- conversion ------------------------------------------------------------------------------------------


def iso_date(date: str) -> str:
    d = (date if date.isdigit() else "").ljust(14, "0")[:14]
    month, day = (x if x != "00" else "01" for x in (d[4:6], d[6:8]))
    return f"{d[:4]}-{month}-{day}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(kind: str, fields: list[tuple[str, str]], block: bytes) -> tuple[bytes, bytes, bytes]:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields), f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n", block, b"\r\n\r\n"


def record_name(arc: str, number: int) -> str:
    """A record's own place, as pages may be there several times."""
    return f"{arc.rpartition('/')[2]}#{number}"


def converted(record: ArcRecord, arc: str, original: tuple[int, str, int] | None) -> tuple[bytes, bytes, bytes]:
    """The WARC record of an ARC record. original: the page whose payload it repeats, its archive and number there."""
    http = record.http
    page = page_of(http[0]) if http else None
    common = [("WARC-Record-ID", urn(record_name(arc, record.number))), ("WARC-Date", iso_date(record.date))]
    if record.number == 0 and record.url.startswith("filedesc:"):
        block = f"software: tradewind\r\nformat: WARC File Format 1.1\r\ndescription: converted from {record.url}\r\n".encode()
        return warc_record("warcinfo", [*common, ("Content-Type", "application/warc-fields")], block)
    common += [("WARC-Target-URI", record.url), ("WARC-IP-Address", record.ip)]
    if not http:
        return warc_record("resource", [*common, ("Content-Type", "text/dns" if record.url.startswith("dns:") else record.kind)], record.body)
    head, payload = http
    common += [("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"), ("Content-Type", "application/http; msgtype=response")]
    if original is None or original[0] == page:
        return warc_record("response", common, record.body)
    common += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", urn(record_name(*original[1:]))), ("X-Refers-To-Page-Id", str(original[0])), ("X-Payload-Length", str(len(payload)))]
    return warc_record("revisit", common, head + b"\r\n\r\n")


def convert(spark: SparkSession, archives: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """WARC archives of ARC archives, one each; the manifest of the former.

    Digests are grouped before anything is joined, and only those that repeat are joined back, so a payload with a third
    of all pages is one row on that side and is split on the other.
    """
    found = stored(captures(archives), f"{folder}/captures")
    repeated = found.where((F.col("payload_bytes") >= least_bytes) & F.col("payload_digest").isNotNull())
    repeated = repeated.groupBy("payload_digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "path", "number"))).alias("first"), F.count("*").alias("n"))
    repeated = repeated.where("n > 1").select("payload_digest", *(F.col(f"first.{c}").alias(f"first_{c}") for c in ("page_id", "path", "number")))
    repeated = stored(repeated, f"{folder}/repeated")
    decided = found.join(repeated, "payload_digest", "left").select("path", "number", "first_page_id", "first_path", "first_number")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, records, stream, out = None, None, None, None
        for part in parts:
            firsts = part[["first_page_id", "first_path", "first_number"]].astype({"first_page_id": "Int64", "first_number": "Int64"})
            for path, number, first in zip(part["path"], part["number"].tolist(), firsts.itertuples(index=False)):
                if path != at:
                    if out:
                        yield pd.DataFrame([out.close()], columns=["path", "records"])
                        stream.close()
                    at, stream = path, opened(path)
                    records, out = read_arc(stream), MemberWriter(f"{folder}/warc", path.rpartition("/")[2].removesuffix(".arc.gz"), ".warc.gz")
                record = next(records)
                if record.number != number:
                    raise ValueError(f"{path}: record {record.number} where {number} was decided")
                out.add(*converted(record, path, None if pd.isna(first[0]) else (int(first[0]), first[1], int(first[2]))))
        if out:
            yield pd.DataFrame([out.close()], columns=["path", "records"])
            stream.close()

    n = max(1, archives.count())
    ordered = decided.repartitionByRange(n, "path").sortWithinPartitions("path", "number")
    return stored(ordered.mapInPandas(run, MANIFEST), f"{folder}/warc-manifest")


# ---- WARC ------------------------------------------------------------------------------------------------


def read_warc(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields with ``WARC-Type`` among them, block) of each record; the block digest is checked."""
    while line := stream.readline():
        if line.strip() == b"":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip()] = v.strip()
        block = _exactly(stream, int(fields["Content-Length"]))
        if fields["WARC-Block-Digest"] != f"sha1:{sha1_base32(block)}":
            raise ValueError(f"{fields['WARC-Record-ID']}: block digest differs")
        yield fields, block


def records(archives: DataFrame) -> DataFrame:
    """Responses and revisits of WARC archives, with size and digest of the full payload."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path in part["path"]:
                rows = []
                with opened(path) as stream:
                    for fields, block in read_warc(stream):
                        kind = fields["WARC-Type"]
                        if kind not in ("response", "revisit"):
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and digest != sha1_base32(payload):
                            raise ValueError(f"{fields['WARC-Record-ID']}: payload digest differs")
                        size = len(payload) if kind == "response" else int(fields["X-Payload-Length"])
                        refers = int(fields["X-Refers-To-Page-Id"]) if kind == "revisit" else None
                        rows.append((page_of(head), size, digest, kind, refers, fields["WARC-Target-URI"], fields["WARC-Record-ID"]))
                out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id"])
                yield out.astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})

    return one_file_each(archives, "path").mapInPandas(run, RECORDS)
