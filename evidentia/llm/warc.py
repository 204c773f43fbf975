"""WARC archives: writing with payload deduplication and segmentation, and reading with reassembly.

A record is one line of Spark's text writer whose line separator is the blank lines that end a WARC
record, so archives are ordinary (gzip) WARC files in any store that Spark can write, committed by
Spark's own protocol. HTTP payloads carry chunked transfer framing; a record block longer than
`segment_bytes` is cut into a first record and continuation records that name it as their origin.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import as_bytes, own_worker, shared_dir, stored

#: Bytes of a record block from which it is cut into segments.
SEGMENT_BYTES = 16_384
#: Payloads shorter than this are never revisits.
REVISIT_BYTES = 1000
#: Bytes of a transfer chunk.
CHUNK_BYTES = 4096
#: Records in one archive file at most.
FILE_RECORDS = 4000
#: Bytes of text in the records that are handed on at once.
_BATCH_BYTES = 8_000_000


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """HTTP/1.1 chunked transfer framing."""
    out = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join(out) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """Undo chunked framing; chunk extensions and trailers are skipped, broken framing is an error."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("CHUNKED:no size line")
        try:
            size = int(body[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            raise ValueError("CHUNKED:bad size") from None
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("CHUNKED:chunk not closed")
        out.append(body[at : at + size])
        at += size + 2


def _header(fields: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _safe(text: str | None) -> str:
    """A header value on one line, percent-encoded where it would break the header."""
    return "".join(c if " " < c < "\x7f" and c != "%" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text or "")


def _uuid(*parts: object) -> str:
    h = hashlib.sha256(repr(parts).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}>"


def _records(segment_bytes: int):
    def of(row: dict, html: bytes, ident: str) -> Iterator[bytes]:
        digest, page = row["payload_digest"], row["page_id"]
        revisit = row["first_page"] is not None
        fields: list[tuple[str, object]] = [
            ("WARC-Type", "revisit" if revisit else "response"),
            ("WARC-Record-ID", ident),
            ("WARC-Target-URI", _safe(row["url"]) or "about:blank"),
            ("WARC-Date", "1970-01-01T00:00:00Z"),
            ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("X-Page-ID", "" if page is None else page),
            ("X-Payload-Length", row["payload_bytes"]),
            ("Content-Type", "application/http;msgtype=response"),
        ]
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
        if revisit:
            fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", row["first_page"])]
            yield _header([*fields, ("Content-Length", len(http))]) + http
            return
        block = http + chunked(html)
        if len(block) <= segment_bytes:
            yield _header([*fields, ("Content-Length", len(block))]) + block
            return
        parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
        yield _header([*fields, ("WARC-Segment-Number", 1), ("Content-Length", len(parts[0]))]) + parts[0]
        for k, part in enumerate(parts[1:], 2):
            last = [("WARC-Segment-Total-Length", len(block))] if k == len(parts) else []
            yield _header([("WARC-Type", "continuation"), ("WARC-Record-ID", _uuid(ident, k)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", ident), ("WARC-Segment-Number", k), *last, ("Content-Length", len(part))]) + part

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("warc")
        part, n = TaskContext.get().partitionId(), 0
        out: list[bytes] = []
        size = 0
        for batch in batches:
            html = as_bytes(batch.column("html"))
            for row, payload in zip(batch.drop_columns(["html"]).to_pylist(), html):
                n += 1
                for record in of(row, payload, _uuid(row["page_id"], part, n)):
                    out.append(record)
                    size += len(record)
                if size > _BATCH_BYTES:
                    yield pa.record_batch([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
        if out:
            yield pa.record_batch([pa.array(out, pa.binary())], names=["record"])

    return run


def write_archives(pages: DataFrame, path: str | None = None, segment_bytes: int = SEGMENT_BYTES) -> str:
    """Write one record per page (plus continuations); returns the folder of the .gz archives.

    Of the pages with equal payloads of REVISIT_BYTES or more, those with the largest page_id are
    responses and the others revisits of it. A null html is an empty payload. Repeated rows of the
    largest page_id are all responses; a null page_id counts as smaller than any other and is a
    response if all are null. An empty table gives a folder without records.
    """
    path = path or f"{shared_dir(pages.sparkSession)}/warc"
    text = F.coalesce(F.col("html"), F.lit(""))
    digest, size = F.sha1(F.encode(text, "UTF-8")).alias("payload_digest"), F.octet_length(text).cast("long").alias("payload_bytes")
    # who revisits whom is settled on narrow rows; the payloads are dealt by page and digest, never by digest alone
    large = pages.select("page_id", digest, size).filter(F.col("payload_bytes") >= REVISIT_BYTES).drop("payload_bytes")
    groups = large.groupBy("payload_digest").agg(F.max("page_id").alias("first_page"), F.count(F.lit(1)).alias("pages")).filter("pages > 1").drop("pages")
    later = large.join(groups, "payload_digest").filter(~F.col("page_id").eqNullSafe(F.col("first_page"))).distinct()
    later = later.select(F.col("page_id").alias("page"), F.col("payload_digest").alias("digest"), "first_page")
    rows = pages.select("page_id", "url", text.alias("html"), digest, size)
    joined = rows.join(later, F.col("page_id").eqNullSafe(F.col("page")) & (F.col("payload_digest") == F.col("digest")), "left")
    records = joined.select("page_id", "url", "payload_digest", "payload_bytes", "first_page", "html").mapInArrow(_records(segment_bytes), "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)
    return path


def records_of(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names lowered) and block of each record of an unpacked archive."""
    at = 0
    while at < len(raw):
        end = raw.find(b"\r\n\r\n", at)
        if end < 0 or not raw.startswith(b"WARC/", at):
            raise ValueError("WARC:bad record header")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in raw[at:end].decode().split("\r\n")[1:])
        fields = {k.lower(): v for k, v in fields.items()}
        size, at = int(fields["content-length"]), end + 4
        if raw[at + size : at + size + 4] != b"\r\n\r\n":
            raise ValueError("WARC:record not closed")
        yield fields, raw[at : at + size]
        at += size + 4


def payload_of(block: bytes) -> bytes:
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep:
        raise ValueError("HTTP:no end of header")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


_READ = "page_id long, record_type string, refers_to long, declared_digest string, declared_bytes long, payload_bytes long, payload_digest string, origin string, segment int, total long, block binary"
_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary()]


def _number(x: str | None) -> int | None:
    return int(x) if x else None


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own_worker("warc")
    names = [x.split()[0] for x in _READ.split(", ")]
    for batch in batches:
        for content in batch.column("content"):
            rows: list[tuple] = []
            size = 0
            for f, block in records_of(gzip.decompress(content.as_py())):
                kind, digest = f["warc-type"], f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                origin = f.get("warc-segment-origin-id") or (f["warc-record-id"] if "warc-segment-number" in f else None)
                own = (_number(f.get("x-page-id")), kind, _number(f.get("x-refers-to-page")), digest, _number(f.get("x-payload-length")))
                if origin:
                    rows.append((*own, None, None, origin, int(f["warc-segment-number"]), _number(f.get("warc-segment-total-length")), block))
                    size += len(block)
                elif kind == "revisit":
                    rows.append((*own, None, None, None, None, None, None))
                else:
                    payload = payload_of(block)
                    rows.append((*own, len(payload), hashlib.sha1(payload).hexdigest(), None, None, None, None))
                if size > _BATCH_BYTES:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=names)


def _reassemble(group: pa.Table) -> pa.Table:
    rows = group.sort_by("segment").to_pylist()
    if [r["segment"] for r in rows] != list(range(1, len(rows) + 1)) or rows[-1]["total"] is None:
        raise ValueError(f"SEGMENTS:missing or repeated of {rows[0]['origin']}")
    block = b"".join(r["block"] for r in rows)
    if len(block) != rows[-1]["total"]:
        raise ValueError(f"SEGMENTS:length {len(block)} is not {rows[-1]['total']}")
    payload = payload_of(block)
    out = rows[0] | {"payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest(), "block": None}
    return pa.Table.from_pylist([out], schema=group.schema)


def read_archives(spark, path: str) -> DataFrame:
    """One row per page record of the archives: what the header declares, and length and SHA-1 of the payload as read.

    Continuations are grouped by their origin, ordered by segment number and checked against the
    total length; only segmented records are shuffled, and a group holds one record. A revisit has no
    payload of its own: length and digest are those read from the response that it refers to, found by
    page and digest. A payload that differs from its header's length or digest stops the job, and so does
    a revisit without such a response. An archive without records gives an empty table.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    read = files.mapInArrow(_read, _READ)
    whole = read.filter("origin is null")
    parts = read.filter("origin is not null").groupBy("origin").applyInArrow(_reassemble, _READ)
    same = (F.col("payload_digest") == F.col("declared_digest")) & (F.col("payload_bytes") == F.col("declared_bytes"))
    fault = lambda what: F.raise_error(F.concat(F.lit(f"WARC:{what} of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("?"))))
    digest = F.when(same, F.col("payload_digest")).otherwise(fault("payload differs"))
    records = stored(whole.unionByName(parts).drop("origin", "segment", "total", "block"), "records")
    responses = records.filter("record_type != 'revisit'").select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")
    there = responses.filter(F.col("payload_bytes") >= REVISIT_BYTES).select(F.col("page_id").alias("page"), F.col("payload_digest").alias("digest"), F.col("payload_bytes").alias("size")).distinct()
    revisits = records.filter("record_type = 'revisit'").drop("payload_bytes", "payload_digest")
    joined = revisits.join(there, (F.col("refers_to") == F.col("page")) & (F.col("declared_digest") == F.col("digest")), "left")
    found = joined.select("page_id", F.when(F.col("size") == F.col("declared_bytes"), F.col("size")).otherwise(fault("no response")).alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
    return responses.unionByName(found)
