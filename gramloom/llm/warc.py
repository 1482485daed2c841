"""Legacy archives: ARC files of both versions, and their conversion to WARC with synthesised headers.

``write_arc`` lays pages down in ARC archives: a version block, whose second line names the version,
then a header line for each record, with five fields in version 1 (URL, IP address, date, content
type, length) and ten in version 2 (result code, checksum, location, offset and file name stand before
the length). ``parse_arc`` reads any archive of these versions, plain or compressed as one gzip member or as many:
it follows the header line of the archive's own version and the declared lengths, and never looks for markers
within a body. ``convert`` synthesises for each record its WARC type, a record id (a name-based UUID of
archive, position, target, date and digest), an ISO timestamp and SHA-1 digests; an archive begins with a warcinfo
record.

Archives are written with a gzip member for each record, so they can be read from any record on. Of records with
equal payloads of at least ``min_bytes`` bytes the one with the smallest page id (null last; then
archive and position) is a response; others are revisits that name it by page, record id, target and date, and hold
no payload.

Defined results: null html is an empty payload; a null URL comes back as null; ties and repeated rows
give one response and revisits; an empty table gives no archive and no row; extra columns are ignored.
A record without HTTP headers is all payload. Archives are bounded by ``ARCHIVE_BYTES`` and ``ARCHIVE_RECORDS``,
whatever the input.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Store, lookup_join, table

ARCHIVE_BYTES, ARCHIVE_RECORDS, PIECE = 8_000_000, 2000, 1 << 14
DATE, IP = "20240101000000", "0.0.0.0"
#: The field names of the two versions of ARC header lines.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:gramloom:warc")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Stream:
    """An archive's bytes in order, whether plain or in gzip members, a piece of ``PIECE`` bytes at a time."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.zipped, self.unzip = memoryview(data), 0, data[:2] == b"\x1f\x8b", None
        self.held, self.pos = bytearray(), 0

    def _more(self) -> bool:
        if self.at >= len(self.data):
            return False
        if self.pos > PIECE:
            del self.held[: self.pos]
            self.pos = 0
        part = self.data[self.at : self.at + PIECE]
        if not self.zipped:
            self.held += part
            self.at += len(part)
            return True
        self.unzip = self.unzip or zlib.decompressobj(31)
        self.held += self.unzip.decompress(part)
        self.at += len(part) - len(self.unzip.unused_data)
        if self.unzip.eof:
            self.unzip = None
        return True

    def read(self, n: int) -> bytes:
        """The next n bytes, or as many as there are."""
        while len(self.held) - self.pos < n and self._more():
            pass
        out = bytes(self.held[self.pos : self.pos + n])
        self.pos += len(out)
        return out

    def line(self) -> bytes | None:
        """Up to the next line feed, without it; None at the end."""
        seen = self.pos
        while (end := self.held.find(b"\n", seen)) < 0:
            left = len(self.held) - self.pos
            if not self._more():
                return self.read(left) or None
            seen = self.pos + left
        out = bytes(self.held[self.pos : end])
        self.pos = end + 1
        return out


def arc_open(name: str, version: int) -> bytes:
    body = f"{version} 0 gramloom\n{' '.join(FIELDS[version])}\n".encode()
    head = [f"filedesc://{name}", IP, DATE, "text/plain", *(("200", "-", "-", "0", name) if version == 2 else ()), str(len(body))]
    return " ".join(head).encode() + b"\n" + body + b"\n"


def arc_record(name: str, version: int, offset: int, url: str | None, page_id: int | None, html: bytes) -> bytes:
    """A record whose body is an HTTP response; the page's number is one of its HTTP headers."""
    body = f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'-' if page_id is None else page_id}\r\n\r\n".encode() + html
    target = _target(url)
    head = [target, IP, DATE, "text/html", *(("200", sha1_base32(html), "-", str(offset), name) if version == 2 else ()), str(len(body))]
    return " ".join(head).encode() + b"\n" + body + b"\n"


def _target(url: str | None) -> str:
    """A URL without blanks, from which _url() has the same text again; - for null."""
    if url is None:
        return "-"
    return "%2D" if url == "-" else quote(url, safe=":/?&=#+,;@!$'()*~[]", errors="surrogatepass")


def _url(target: str) -> str | None:
    return None if target == "-" else unquote(target, errors="surrogatepass")


def parse_arc(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, body) of each record after the version block."""
    stream, fields = _Stream(archive), None
    while (line := stream.line()) is not None:
        if not line.strip():  # what parts records
            continue
        text = line.decode("utf-8", "surrogateescape").rstrip("\r")
        length = text.rpartition(" ")[2]
        if not length.isdecimal():
            raise ValueError(f"a header line has no length: {text[:200]!r}")
        body = stream.read(int(length))
        if len(body) != int(length) or stream.line():
            raise ValueError(f"a record's declared length is wrong: {text[:200]!r}")
        if fields is None:
            version = body.split(b" ", 1)[0]
            if not text.startswith("filedesc://") or version not in (b"1", b"2"):
                raise ValueError(f"not an archive of version 1 or 2: {text[:200]!r}")
            fields = FIELDS[int(version)]
            continue
        # a target may hold blanks, the other fields don't
        values = text.rsplit(" ", len(fields) - 1)
        if len(values) != len(fields):
            raise ValueError(f"a header line has {len(values)} fields, not {len(fields)}: {text[:200]!r}")
        yield dict(zip(fields, values)), body


def _http(body: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP headers and payload; a body that doesn't begin with a status line is all payload."""
    if not body.startswith(b"HTTP/"):
        return {}, body
    ends = [(at, size) for mark, size in ((b"\r\n\r\n", 4), (b"\n\n", 2)) if (at := body.find(mark)) >= 0]
    at, size = min(ends, default=(len(body), 0))
    lines = body[:at].decode("utf-8", "surrogateescape").splitlines()[1:]
    return {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, body[at + size :]


def _page(http: dict[str, str]) -> int | None:
    number = http.get("X-Page-Id", "-")
    return int(number) if number.lstrip("-").isdecimal() else None


def _stamp(day: str) -> str:
    day = day.ljust(14, "0")
    return f"{day[:4]}-{day[4:6]}-{day[6:8]}T{day[8:10]}:{day[10:12]}:{day[12:14]}Z"


def record_id(archive: str, pos: int, fields: dict[str, str], digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{archive} {pos} {fields["URL"]} {fields["Archive-date"]} {digest}')}>"


def _record(head: dict[str, str], block: bytes) -> bytes:
    head |= {"WARC-Block-Digest": f"sha1:{sha1_base32(block)}", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode("utf-8", "surrogateescape") + b"\r\n" + block + b"\r\n\r\n"


def warc_open(archive: str) -> bytes:
    """The record that describes an archive, named by the ARC archive it comes from."""
    name = archive.replace(".arc", ".warc")
    head = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(NAMESPACE, archive)}>", "WARC-Date": _stamp(DATE), "WARC-Filename": name, "Content-Type": "application/warc-fields"}
    return _record(head, f"software: gramloom\r\nformat: WARC File Format 1.1\r\ndescription: converted from {archive}\r\n".encode())


def convert(archive: str, pos: int, fields: dict[str, str], body: bytes, refers: dict | None) -> bytes:
    """A WARC record for the ARC record at ``pos``; ``refers`` (page, target, record id and date of the response) makes it a revisit."""
    http, payload = _http(body)
    digest = sha1_base32(payload)
    head = {
        "WARC-Type": "revisit" if refers else "response",
        "WARC-Record-ID": record_id(archive, pos, fields, digest),
        "WARC-Warcinfo-ID": f"<urn:uuid:{uuid.uuid5(NAMESPACE, archive)}>",
        "WARC-Date": _stamp(fields["Archive-date"]),
        "WARC-Target-URI": fields["URL"],
        "WARC-IP-Address": fields["IP-address"],
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response" if http else fields["Content-type"],
        "X-Payload-Length": str(len(payload)),
        "X-Page-Id": http.get("X-Page-Id", "-"),
    }
    block = body
    if refers:
        block = body[: len(body) - len(payload)]
        head |= {
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            "WARC-Refers-To": refers["ref_id"],
            "WARC-Refers-To-Target-URI": refers["ref_target"],
            "WARC-Refers-To-Date": refers["ref_date"],
            "X-Refers-To-Page": str("-" if refers["ref_page"] is None else refers["ref_page"]),
        }
    return _record(head, block)


def parse_warc(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, the warcinfo one too, by its headers and declared length."""
    stream = _Stream(archive)
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"not a WARC record: {line[:200]!r}")
        head = {}
        while (line := stream.line()) not in (None, b"\r", b""):
            k, _, v = line.decode("utf-8", "surrogateescape").rstrip("\r").partition(": ")
            head[k] = v
        block = stream.read(int(head["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n" or f"sha1:{sha1_base32(block)}" != head.get("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"):
            raise ValueError("a WARC record is damaged")
        yield head, block


def write_arc(pages: DataFrame, versions: tuple[int, ...] = (1, 2)) -> DataFrame:
    """(archive, data): ARC archives of gzip members; the archives of a task take the versions in turn."""

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0

        def start() -> tuple[str, int, list[bytes], int, int]:
            name, version = f"part{task:07d}-{n:06d}.arc.gz", versions[n % len(versions)]
            first = _member(arc_open(name, version))
            return name, version, [first], len(first), 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([b"".join(parts)], pa.binary())], ["archive", "data"])

        name, version, parts, size, count = start()
        for batch in batches:
            for k in range(len(batch)):
                page, url, html = (batch.column(c)[k].as_py() for c in range(3))
                parts.append(_member(arc_record(name, version, size, url, page, (html or "").encode("utf-8", "surrogatepass"))))
                size, count = size + len(parts[-1]), count + 1
                if size >= ARCHIVE_BYTES or count >= ARCHIVE_RECORDS:
                    yield row()
                    n += 1
                    name, version, parts, size, count = start()
        if count:
            yield row()

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(lay, "archive string, data binary")


def arc_index(archives: DataFrame) -> DataFrame:
    """(archive, pos, page_id, target, date, record_id, payload_bytes, payload_digest) of each ARC record."""
    schema = "archive string, pos long, page_id long, target string, date string, record_id string, payload_bytes long, payload_digest string"
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for pos, (fields, body) in enumerate(parse_arc(data.as_py())):
                    http, payload = _http(body)
                    digest = sha1_base32(payload)
                    rows.append((name, pos, _page(http), fields["URL"], _stamp(fields["Archive-date"]), record_id(name, pos, fields, digest), len(payload), digest))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], [x.split()[0] for x in schema.split(", ")])

    return archives.select("archive", "data").mapInArrow(scan, schema)


def revisits(index: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(archive, pos, ref_page, ref_target, ref_date, ref_id) of the records that repeat an earlier payload."""
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "archive", "pos", "target", "date", "record_id")
    index = index.filter(F.col("payload_bytes") >= min_bytes)
    first = index.groupBy("payload_digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1")
    total = index.count()
    hit = lookup_join(index.select("archive", "pos", "payload_digest"), first, ["payload_digest"], "n", total)
    hit = hit.filter("archive <> first.archive or pos <> first.pos")
    return hit.select("archive", "pos", *(F.col(f"first.{c}").alias(n) for c, n in (("page_id", "ref_page"), ("target", "ref_target"), ("date", "ref_date"), ("record_id", "ref_id"))))


def to_warc(archives: DataFrame, repeats: DataFrame) -> DataFrame:
    """(archive, data): WARC archives, with a warcinfo record and a record for each ARC record."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data, again in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                refers = {x["pos"]: x for x in again or ()}
                parts = [_member(warc_open(name)), *(_member(convert(name, pos, fields, body, refers.get(pos))) for pos, (fields, body) in enumerate(parse_arc(data.as_py())))]
                yield pa.RecordBatch.from_arrays([pa.array([name.replace(".arc", ".warc")], pa.string()), pa.array([b"".join(parts)], pa.binary())], ["archive", "data"])

    # an archive has ARCHIVE_RECORDS records at most, and so has a group
    by_archive = repeats.groupBy("archive").agg(F.collect_list(F.struct("pos", "ref_page", "ref_target", "ref_date", "ref_id")).alias("again"))
    return archives.join(by_archive, "archive", "left").select("archive", "data", "again").mapInArrow(write, "archive string, data binary")


def read_warc(archives: DataFrame) -> DataFrame:
    """A row for each WARC record; size and digest of a response come from its payload, of a revisit from its headers."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "date", "refers_to_id"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: None if x in (None, "-") else int(x)
        for batch in batches:
            for data in batch.column(1):
                rows = []
                for head, block in parse_warc(data.as_py()):
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    size, digest = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].partition(":")[2]
                    if head["WARC-Type"] == "response":
                        payload = _http(block)[1]
                        if (len(payload), sha1_base32(payload)) != (size, digest):
                            raise ValueError("a payload differs from its digest")
                    rows.append((number(head["X-Page-Id"]), _url(head["WARC-Target-URI"]), size, digest, head["WARC-Type"], number(head.get("X-Refers-To-Page")), head["WARC-Record-ID"], head["WARC-Date"], head.get("WARC-Refers-To")))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

    return archives.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, date string, refers_to_id string")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``pages`` through ARC archives of both versions into WARC archives, and read back."""
    store = Store(spark, "warc")
    arcs = store.keep(write_arc(table(spark, sf_dir, "pages")), "arc", codec="none")
    repeats = store.keep(revisits(store.keep(arc_index(arcs), "index")), "revisits")
    warcs = store.keep(to_warc(arcs, repeats), "warc", codec="none")
    store.only("warc")
    return read_warc(warcs).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
