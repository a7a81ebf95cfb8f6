"""ARC archives converted to WARC.

ARC is read by its version's header line: version 1 has `url ip date type length`, version 2 `url ip date type status
checksum location offset file length`; a record's content is what its declared length says, whatever it holds. Each
record becomes a WARC record with the equivalent target, date, type, identifier (a UUID named by target, date, digest
and record) and digests (bare base32 SHA-1). Records of equal payloads become one response, that of the largest id, and
revisits that refer to it.

Tasks put records together until an archive has ARCHIVE_BYTES; archives are written by Spark's text writer, one per file,
and read by its binaryFile source, so any store will do. Which record a revisit refers to is found from digests, and only
digests that occur more than once are kept, broadcast if they are few; if they are many, pages are shuffled by digest,
those of one digest to several tasks.

Defined cases: a null payload is empty; null or blank targets become `urn:none`; a null id makes a record without id,
which revisits a record of equal payload that has one; rows that repeat an id and a payload are of one type; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, shared_path, ship, spread_join, stored

#: Fields of an ARC record's header line, by the version in the file's own header.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "file", "length"),
}
ARC_TITLES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Bytes from which on an archive is closed; a larger record is an archive of its own.
ARCHIVE_BYTES = 32 << 20


class ArcRecord(NamedTuple):
    url: str
    ip: str
    date: str
    type: str
    content: bytes
    status: str = "-"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_url(url: str | None) -> str:
    """A target without white space or control characters, as a header line needs it."""
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    return clean or "urn:none"


def write_arc(records: list[ArcRecord], version: int, name: str = "legacy.arc", date: str = "20000101000000") -> bytes:
    """An ARC file of version 1 or 2."""
    about = f"{version} 0 converter\n{ARC_TITLES[version]}\n\n".encode()
    extra = " 200 - - 0 " + name if version == 2 else ""
    out = [f"filedesc://{name} 0.0.0.0 {date} text/plain{extra} {len(about)}\n".encode(), about, b"\n"]
    at = sum(map(len, out))
    for r in records:
        middle = f" {r.status} {digest_of(r.content)} - {at} {name}" if version == 2 else ""
        head = f"{r.url} {r.ip} {r.date} {r.type}{middle} {len(r.content)}\n".encode()
        out += [head, r.content, b"\n"]
        at += len(head) + len(r.content) + 1
    return b"".join(out)


def read_arc(raw: bytes) -> Iterator[ArcRecord]:
    """Records after the file's header; the header's second line tells the version."""
    fields, at = None, 0
    while at < len(raw):
        if raw[at : at + 1] in b"\r\n":  # records are set apart by line ends
            at += 1
            continue
        end = raw.index(b"\n", at)
        line = raw[at:end].decode("utf-8", "replace").rstrip("\r")
        if fields is None:
            if not line.startswith("filedesc://"):
                raise ValueError("an ARC file begins with a filedesc record")
            version = int(raw[end + 1 : raw.index(b" ", end)])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} is not known")
            fields = ARC_FIELDS[version]
            at = end + 1 + int(line.rsplit(" ", 1)[1])
            continue
        values = line.rsplit(" ", len(fields) - 1)
        if len(values) != len(fields):
            raise ValueError(f"an ARC header line has {len(values)} fields: {line[:200]!r}")
        got = dict(zip(fields, values, strict=True))
        at = end + 1 + int(got["length"])
        if at > len(raw):
            raise ValueError("an ARC record is cut off")
        yield ArcRecord(got["url"], got["ip"], got["date"], got["type"], raw[end + 1 : at], got.get("status", "-"))


def warc_date(date: str) -> str:
    """ARC's digits (8, 10, 12 or 14 of them) as a WARC date."""
    d = date + "00010101000000"[len(date) :] if len(date) < 8 else date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def http_payload(content: bytes) -> tuple[bytes, bytes]:
    """Head and entity of a captured HTTP response; other content has no head."""
    if content.startswith(b"HTTP/") and (cut := content.find(b"\r\n\r\n")) >= 0:
        return content[: cut + 4], content[cut + 4 :]
    return b"", content


def record_id(url: str, date: str, digest: str, page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {digest} {page_id}')}>"


def to_warc(r: ArcRecord, page_id: int | None, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """The WARC record of an ARC record, a revisit if it refers to another page."""
    head, payload = http_payload(r.content)
    digest, date = digest_of(payload), warc_date(r.date)
    revisit = refers_to is not None
    kind = "revisit" if revisit else "response" if head else "resource"
    block = head if revisit else r.content
    lines = [
        "WARC/1.0",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(r.url, date, digest, page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {r.url}",
        f"WARC-IP-Address: {r.ip}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}",
        f"Content-Type: {'application/http; msgtype=response' if head else r.type}",
        f"Content-Length: {len(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_url or '', date, digest, refers_to)}", f"WARC-Refers-To-Target-URI: {refers_url or ''}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record, by declared lengths; digests are checked."""
    at = 0
    while at < len(raw):
        cut = raw.index(b"\r\n\r\n", at)
        version, *lines = raw[at:cut].decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:60]!r}")
        headers = dict(x.split(": ", 1) for x in lines)
        end = cut + 4 + int(headers["Content-Length"])
        block = raw[cut + 4 : end]
        if raw[end : end + 4] != b"\r\n\r\n":
            raise ValueError("a WARC record is cut off")
        if (want := headers.get("WARC-Block-Digest")) and want != f"sha1:{digest_of(block)}":
            raise ValueError("a WARC block is damaged")
        yield headers, block
        at = end + 4


def convert(pages: DataFrame, path: str, least: int = 0, date: str = "20000101000000", key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Write pages as ARC records (versions 1 and 2 in turn by task), convert those, and write the WARC files to path.

    least: payloads of fewer bytes are always responses of their own.
    """
    spark = pages.sparkSession
    ship(spark)
    body = F.coalesce(F.col(payload), F.lit(""))
    slim = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"), F.when(F.octet_length(body) >= least, F.sha1(body.cast("binary"))).alias("sha"))
    equal = slim.where("sha is not null").groupBy("sha").agg(F.max_by("url", "page_id").alias("owner_url"), F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1 and owner is not null")
    owners = stored(equal.select("sha", "owner", "owner_url"), "owners")
    decided = spread_join(slim, owners, "sha", "left", "page_id")
    refers = F.when(F.col("owner").isNotNull() & ~F.col("owner").eqNullSafe(F.col("page_id")), F.col("owner"))
    decided = decided.select("page_id", "url", "payload", refers.alias("refers_to"), "owner_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version = 1 + TaskContext.get().partitionId() % 2
        held, size = [], 0

        def archive() -> pa.RecordBatch:
            # The writer adds the last line feed.
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["record"])

        for batch in batches:
            for b in pieces(batch, 2):
                ids, urls, refs, others = (b.column(i).to_pylist() for i in (0, 1, 3, 4))
                bodies = b.column(2).cast(pa.binary()).to_pylist()
                contents = [b"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(p) + p for p in bodies]
                legacy = write_arc([ArcRecord(arc_url(u), "0.0.0.0", date, "text/html", c, "200") for u, c in zip(urls, contents, strict=True)], version)
                made = [to_warc(r, i, ref, arc_url(o)) for r, i, ref, o in zip(read_arc(legacy), ids, refs, others, strict=True)]
                for m in made:
                    if held and size + len(m) > ARCHIVE_BYTES:
                        yield archive()
                        held, size = [], 0
                    held.append(m)
                    size += len(m)
        if held:
            yield archive()

    rows = decided.mapInArrow(run, "record binary").select(F.col("record").cast("string"))
    rows.write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of all records in the files."""
    ship(spark)
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    names = [x.split()[0] for x in schema.split(", ")]

    def row(headers: dict[str, str], block: bytes) -> tuple:
        number = lambda k: int(headers[k]) if k in headers else None
        digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
        payload = None if kind == "revisit" else http_payload(block)[1]
        if payload is not None and (digest_of(payload) != digest or len(payload) != number("X-Payload-Length")):
            raise ValueError("a payload differs from its digest")
        return number("X-Page-ID"), headers["WARC-Target-URI"], number("X-Payload-Length"), digest, kind, number("X-Refers-To-Page-ID"), payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for b in batches:
            for content in b.column(0):
                rows = []
                for headers, block in read_warc(content.as_py()):
                    got = row(headers, block)
                    rows.append(got if with_payload else (*got[:6], None))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)][: len(names)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)][: len(names)], names=names)

    return spark.read.format("binaryFile").load(f"{path}/part-*").select("content").mapInArrow(run, schema)


def arc_to_warc(pages: DataFrame, path: str | None = None, **options: object) -> DataFrame:
    """Convert pages into path (default: a fresh shared folder) and read the archives back."""
    path = path or shared_path(pages.sparkSession, "warc")
    convert(pages, path, **options)
    return read_archives(pages.sparkSession, path)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: all pages archived and read back."""
    return arc_to_warc(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS owner FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(x, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN owner IS NULL OR owner IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN owner IS DISTINCT FROM page_id THEN owner END AS refers_to
FROM g
"""
