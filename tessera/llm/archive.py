"""Legacy archive converter: ARC archives of versions 1 and 2 to WARC records, and reading WARC archives back.

An archive file is built in a task as one value of FILE_BYTES or one longer record, and Spark's text writer puts each value,
byte for byte, into a compressed file of its own; the value's last line end is the writer's line separator.  Files are read
whole as binary ones, one to a batch, and cut by declared lengths only.  Payloads are bytes throughout.
"""

from __future__ import annotations

import contextlib
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, run_dir

#: Payload bytes from which equal payloads are stored once; bytes from which a task begins a new archive file.
REVISIT_FROM, FILE_BYTES = 1_000, 8_000_000
#: Rows of a batch of records, which hold whole payloads.
RECORD_ROWS = 64
#: Of the writer: a value a file, compressed fast.
WRITER = {"compression": "gzip", "maxRecordsPerFile": "1", "zlib.compress.level": "BEST_SPEED"}
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
SPACE_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the published name space of URLs
END = "\r\n\r\n"
#: Fields of an URL record, by version.
FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "code", "checksum", "location", "offset", "file", "length"),
}
TITLES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


def arc_version_block(version: int, name: str, date: str) -> str:
    """The record that opens an ARC file and tells its version."""
    body = f"{version} 0 archive\n{TITLES[version]}\n"
    head = {1: f"filedesc://{name} 0.0.0.0 {date} text/plain {len(body)}", 2: f"filedesc://{name} 0.0.0.0 {date} text/plain 200 - - 0 {name} {len(body)}"}[version]
    return f"{head}\n{body}"


def _token(value: str | None) -> str:
    """A header field: no white space, '-' if there is none."""
    return re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value or "") or "-"


def arc_record(version: int, name: str, offset: int, url: str | None, date: str, mime: str, content: bytes, ip: str = "0.0.0.0") -> bytes:
    fields = {"url": _token(url), "ip": ip, "date": date, "mime": mime, "code": "200", "checksum": "-", "location": "-", "offset": offset, "file": name, "length": len(content)}
    return " ".join(str(fields[f]) for f in FIELDS[version]).encode() + b"\n" + content


def read_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC file, the opening one with its description among them: header fields and the content.

    Line feeds between records are skipped.  A header line that the file's version does not explain, or a length
    beyond the file's end, raises ValueError.
    """
    at, version = 0, None
    while True:
        while data[at : at + 1] == b"\n":
            at += 1
        if at >= len(data):
            return
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"no end of the header line at byte {at}")
        parts = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        if version is None:
            body = data[end + 1 : end + 1 + int(parts[-1])]
            version = int(body.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version}")
        names = FIELDS[version]
        if len(parts) < len(names) or not parts[-1].isdigit():
            raise ValueError(f"not a header of version {version}: {parts}")
        # spaces in an URL that the writer left as they are belong to the URL
        values = [" ".join(parts[: len(parts) - len(names) + 1]), *parts[len(parts) - len(names) + 1 :]]
        record = dict(zip(names, values, strict=True)) | {"version": version}
        length = int(record["length"])
        if end + 1 + length > len(data):
            raise ValueError(f"a record of {length} bytes at byte {end + 1} of {len(data)}")
        record["content"] = data[end + 1 : end + 1 + length]
        at = end + 1 + length
        yield record


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """HTTP head with its closing empty line, and body; all is body if there is no head."""
    if content.startswith(b"HTTP/"):
        end = content.find(b"\r\n\r\n")
        if end >= 0:
            return content[: end + 4], content[end + 4 :]
    return b"", content


def http_field(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode("utf-8", "replace") if m else None


def warc_date(arc_date: str) -> str:
    """ARC dates have 14 digits, or 12 or 8 in old files; what is missing is the least."""
    digits = (arc_date + "19700101000000"[len(arc_date) :])[:14]
    return datetime.strptime(digits, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(url: str, date: str, digest: str, key: str) -> str:
    """The same identifier whenever the same record is converted."""
    return f"<urn:uuid:{uuid.uuid5(SPACE_ID, ' '.join((url, date, digest, key)))}>"


def described(record: dict) -> bool:
    """Whether the record describes its file instead of holding a page."""
    return record["url"].startswith("filedesc://")


def warc_record(kind: str, fields: dict[str, str | int | None], content: bytes) -> bytes:
    """A record with the fields that are not None, and its length."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in fields.items() if v is not None], f"Content-Length: {len(content)}"]
    return ("\r\n".join(lines) + END).encode() + content


def info_record(record: dict) -> bytes:
    """The description of an ARC file as a warcinfo record, which keeps the lines that told its version and fields."""
    name, date = record["url"].removeprefix("filedesc://"), warc_date(record["date"])
    first, _, rest = record["content"].decode("utf-8", "replace").partition("\n")
    body = f"software: ARC converter\r\nformat: WARC File Format 1.1\r\nconverted-from: {name}\r\narc-version: {first.strip()}\r\narc-fields: {rest.strip().splitlines()[0] if rest.strip() else ''}\r\n".encode()
    fields = {"WARC-Record-ID": record_id(record["url"], date, hashlib.sha1(body).hexdigest(), "warcinfo"), "WARC-Date": date, "WARC-Filename": name, "WARC-Block-Digest": f"sha1:{hashlib.sha1(body).hexdigest()}", "Content-Type": "application/warc-fields"}
    return warc_record("warcinfo", fields, body)


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and blocks of a WARC file's records."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8").split("\r\n")
        if end < 0 or not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(headers["content-length"])
        if data[end + 4 + length : end + 8 + length] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end after {length} bytes")
        yield headers, data[end + 4 : end + 4 + length]
        at = end + 8 + length


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, what runs gets batches of so many rows; afterwards the session has its own setting again."""
    before = spark.conf.get(ROWS, None)
    spark.conf.set(ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(ROWS) if before is None else spark.conf.set(ROWS, before)


def _write(values: DataFrame, path: str, last: str) -> None:
    """A file for each binary value, to which the writer adds its last line end.  The cast keeps all bytes as they are."""
    values.select(F.col("value").cast("string")).write.options(**WRITER).option("lineSep", last).text(path)


def write_arc(pages: DataFrame, path: str, date: str = "20240101000000") -> None:
    """pages (page_id, url, html) as ARC files, by turns of versions 1 and 2; a null html has an empty body.

    html may be binary.  The page's id is kept in a field of the archived HTTP head.  A file begins with its version block and
    is closed once it has FILE_BYTES.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, files = TaskContext.get().partitionId(), 0
        version, held, size = 1 + part % 2, [], 0
        for b in batches:
            for page, url, html in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if not held:
                    name = f"part-{part:05d}-{files:05d}.arc"
                    held, files = [arc_version_block(version, name, date).encode()], files + 1
                    size = len(held[0])
                body = html or b""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n" + ("" if page is None else f"X-Page-Id: {page}\r\n") + "\r\n"
                held.append(arc_record(version, name, size, url, date, "text/html", head.encode() + body))
                size += len(held[-1]) + 1
                if size >= FILE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"\n".join(held)], pa.binary())], names=["value"])
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"\n".join(held)], pa.binary())], names=["value"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("binary").alias("html"))
    with batches_of(pages.sparkSession, RECORD_ROWS):
        _write(rows.mapInArrow(run, "value binary"), path, "\n")


def plain(data: bytes) -> bytes:
    """The bytes of an archive file, which may be compressed as a whole or by record."""
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where("length > 0").select("content")


RECORD = "page_id long, url string, date string, ip string, mime string, digest string, bytes long, record_id string, info binary, head binary, payload binary"


def arc_records(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """Records of ARC files: page_id, url, date (as in WARC), ip, mime, digest, bytes, record_id; head and payload if whole.

    A file's description has its warcinfo record in info and no digest; info is null for all others.  Run it within
    batches_of(spark, 1), so that a task holds one file.
    """
    names = [f.split()[0] for f in RECORD.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary()]

    def row(r: dict) -> tuple:
        date = warc_date(r["date"])
        if described(r):
            return None, r["url"], date, r["ip"], r["mime"], None, 0, record_id(r["url"], date, "", "filedesc"), info_record(r), None, None
        head, payload = split_http(r["content"])
        page, digest = http_field(head, "X-Page-Id"), hashlib.sha1(payload).hexdigest()
        key = int(page) if page and page.lstrip("-").isdigit() else None
        return key, r["url"], date, r["ip"], r["mime"], digest, len(payload), record_id(r["url"], date, digest, page or ""), None, head if whole else None, payload if whole else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for r in read_arc(plain(content.as_py())):
                    rows.append(row(r))
                    size += rows[-1][6] if whole else 1
                    if size >= FILE_BYTES or len(rows) >= 512:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return _files(spark, path).mapInArrow(run, RECORD)


def converted(r: dict) -> bytes:
    """A row of arc_records, with the revisited record in refers_to, refers_page and refers_date, as a WARC record.

    What has an HTTP head is a response, or a revisit without its payload; anything else a resource of its own type.
    """
    if r["info"] is not None:
        return r["info"]
    revisit = r["refers_to"] is not None
    content = r["head"] if revisit else r["head"] + r["payload"]
    kind = "revisit" if revisit else "response" if r["head"] else "resource"
    fields = {
        "WARC-Record-ID": r["record_id"],
        "WARC-Date": r["date"],
        "WARC-Target-URI": r["url"],
        "WARC-IP-Address": None if r["ip"] in (None, "", "-", "0.0.0.0") else r["ip"],
        "WARC-Payload-Digest": f"sha1:{r['digest']}",
        "WARC-Block-Digest": f"sha1:{hashlib.sha1(content).hexdigest()}",
        "WARC-Refers-To": r["refers_to"],
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
        "Payload-Length": r["bytes"],
        "Refers-To-Page-Id": r["refers_page"] if revisit else None,
        "Content-Type": "application/http; msgtype=response" if r["head"] else r["mime"] or "application/octet-stream",
    }
    return warc_record(kind, fields, content)


def convert(spark: SparkSession, arc_path: str, warc_path: str, revisit_from: int = REVISIT_FROM) -> None:
    """ARC files to WARC files.  Of records with equal payloads of at least revisit_from bytes, that of the
    largest page_id is the response and the others are revisits of it, without a payload.

    Only digests and identifiers are grouped.  Records are converted where their ARC file is read, so payloads are not
    shuffled; a WARC file is closed once it has FILE_BYTES, and begins with the descriptions of the ARC files it is from.
    """
    with batches_of(spark, 1):
        keys = materialize(arc_records(spark, arc_path, whole=False).where("digest IS NOT NULL").select("page_id", "digest", "bytes", "record_id"), "digests")
    best = F.max(F.struct(F.col("page_id").isNotNull().alias("named"), "page_id", "record_id")).alias("best")
    copies = keys.where(F.col("bytes") >= revisit_from).groupBy("digest", "bytes").agg(F.count("*").alias("n"), best).where("n > 1")
    revisits = keys.join(copies, ["digest", "bytes"]).where("record_id <> best.record_id").select("record_id", F.col("best.record_id").alias("refers_to"), F.col("best.page_id").alias("refers_page")).distinct()
    with batches_of(spark, 1):
        # a file's records are read and joined in one stage; the join is by identifier alone
        rows = arc_records(spark, arc_path).join(materialize(revisits, "revisits"), "record_id", "left")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for b in batches:
                for r in b.to_pylist():
                    held.append(converted(r))
                    size += len(held[-1])
                    if size >= FILE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([END.encode().join(held)], pa.binary())], names=["value"])
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([END.encode().join(held)], pa.binary())], names=["value"])

        spark.conf.set(ROWS, str(RECORD_ROWS))
        _write(rows.mapInArrow(run, "value binary"), warc_path, END)


INDEX = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, date string, ip string, content_type string"


def warc_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per WARC record but warcinfo: page_id, payload_bytes, payload_digest, record_type, refers_to, the
    identifiers, ip and content type.  A payload that is not that of its digest raises.  Run it within batches_of(spark, 1).
    """
    names = [f.split()[0] for f in INDEX.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.string()] * 5]

    def row(h: dict[str, str], block: bytes) -> tuple:
        head, payload = split_http(block)
        page, refers, digest = http_field(head, "X-Page-Id"), h.get("refers-to-page-id"), h["warc-payload-digest"].removeprefix("sha1:")
        if h["warc-type"] != "revisit" and hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"the payload of {h['warc-record-id']} is not that of its digest")
        key = int(page) if page and page.lstrip("-").isdigit() else None
        return key, int(h["payload-length"]), digest, h["warc-type"], int(refers) if refers else None, h["warc-record-id"], h["warc-target-uri"], h["warc-date"], h.get("warc-ip-address"), h["content-type"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows = [row(h, block) for h, block in read_warc(plain(content.as_py())) if h["warc-type"] != "warcinfo"]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return _files(spark, path).mapInArrow(run, INDEX)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """pages through ARC archives and their conversion to WARC, read back: a row per page, as warc_index gives it.

    A null html is an empty payload; html may be binary and need not be UTF-8; a null url becomes '-'.  Of equal long payloads
    with one largest page_id on several rows, the row of the largest identifier is the response; rows that are equal in
    url, payload and page_id are one record written twice, both of the same type.  An empty table gives no row.
    """
    spark = pages.sparkSession
    base = f"{run_dir(spark)}/archives-{uuid.uuid4().hex}"
    write_arc(pages, f"{base}/arc")
    convert(spark, f"{base}/arc", f"{base}/warc")
    with batches_of(spark, 1):
        return materialize(warc_index(spark, f"{base}/warc"), "archive-index")
