"""WARC archives: writing records in segments, and reassembling them.

Writing: each page is an HTTP response with a chunked body.  A record whose block is
longer than a segment is split: the first part keeps its type and says segment 1, the
rest are continuation records that name the first by WARC-Segment-Origin-ID, and the
last gives the total length.  Records with equal payloads are stored once; the others
revisit that one.

Reading: files are cut into records by their Content-Length; segments are grouped by
origin, ordered by number, checked for gaps and against the total length, joined, and
the chunked framing is decoded.

The archives are written by Spark's text sink with the record separator CR LF CR LF as
its line separator, so the commit protocol keeps a lost task from leaving pieces, and
any store that Spark writes to will do.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.session import ship

SEPARATOR = "\r\n\r\n"
SEGMENT = 1 << 16
CHUNK = 1 << 13
PER_FILE = 4096


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The chunked transfer framing of a payload."""
    out = []
    for k in range(0, len(payload), size):
        part = payload[k : k + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join(out) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are skipped, a torn body is an error."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size without an end")
        n = int(body[at:end].split(b";", 1)[0].strip() or b"x", 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if len(body) < at + n + 2 or body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk shorter than its size")
        out.append(body[at : at + n])
        at += n + 2


def _id(kind: str, *parts) -> str:
    h = hashlib.md5("\x00".join(map(str, (kind, *parts))).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def _line(value: object) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", str(value))


def records(page_id: int | None, url: str | None, payload: bytes, revisits: int | None, row: str, segment: int = SEGMENT) -> list[bytes]:
    """The WARC records of one page, without separators."""
    own = _id("record", page_id, row)
    digest = base32_sha1(payload)
    fields: list[tuple[str, object]] = [("WARC-Record-ID", own), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if page_id is not None:
        fields.append(("X-Page-ID", page_id))
    if url is not None:
        fields.append(("WARC-Target-URI", _line(url)))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", len(payload))]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if revisits is not None:
        fields += [
            ("WARC-Type", "revisit"),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("X-Refers-To-Page-ID", revisits),
            ("Content-Type", "application/http;msgtype=response"),
        ]
        return [_record(fields, http)]
    block = http + chunked(payload)
    fields += [("WARC-Type", "response"), ("Content-Type", "application/http;msgtype=response")]
    parts = [block[k : k + segment] for k in range(0, len(block), segment)]
    if len(parts) == 1:
        return [_record(fields, block)]
    out = [_record([*fields, ("WARC-Segment-Number", 1)], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        more: list[tuple[str, object]] = [
            ("WARC-Record-ID", _id("segment", page_id, row, n)),
            ("WARC-Date", "1970-01-01T00:00:00Z"),
            ("WARC-Type", "continuation"),
            ("WARC-Segment-Origin-ID", own),
            ("WARC-Segment-Number", n),
        ]
        if n == len(parts):
            more.append(("WARC-Segment-Total-Length", len(block)))
        out.append(_record(more, part))
    return out


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in cuts of a few rows, so that what Python holds of one stays small."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _writer(batches: Iterator[pa.RecordBatch], segment: int) -> Iterator[pa.RecordBatch]:
    task, n = TaskContext.get().partitionId(), 0
    for batch in _pieces(batches):
        out, size = [], 0
        for page_id, url, payload, revisits in zip(*(c.to_pylist() for c in batch.columns)):
            n += 1  # record ids differ even for repeated rows; only one attempt of a task is committed
            for r in records(page_id, url, payload or b"", revisits, f"{task}/{n}", segment):
                out.append(r)
                size += len(r)
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                out, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])


def write_archives(pages: DataFrame, path: str, least: int = 0, segment: int = SEGMENT) -> None:
    """(page_id, url, html, ...) -> gzipped WARC files in path; one logical record per row.

    The payload is html in UTF-8, a null one is empty.  Of the records with equal payloads
    of at least `least` bytes, that with the smallest page_id is the response and the
    others revisit it; smaller payloads are all responses.  A row without a page_id, or
    one that repeats the smallest page_id, is a response too, as nothing else could name
    it.  Payloads are compared by SHA-1 and length.  A file has PER_FILE records at most.
    """
    ship(pages.sparkSession)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "n": F.octet_length("payload")})
    first = rows.where(F.col("n") >= least).groupBy("digest", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    first = first.where((F.col("copies") > 1) & F.col("first").isNotNull()).select("digest", "n", "first")
    joined = rows.join(first, ["digest", "n"], "left")
    revisits = F.when(F.col("first") < F.col("page_id"), F.col("first"))
    ready = joined.select("page_id", "url", "payload", revisits.alias("revisits"))
    made = ready.mapInArrow(lambda b: _writer(b, segment), "record binary")
    text = made.select(F.col("record").cast("string").alias("value"))
    text.write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", PER_FILE).option("compression", "gzip").text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive: fields (lower-case names) and block."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no record at byte {at}")
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError("record without an end of its fields")
        fields = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        n, at = int(fields["content-length"]), end + 4
        if data[at + n : at + n + 4] != b"\r\n\r\n":
            raise ValueError("record not as long as it says")
        yield fields, data[at : at + n]
        at += n + 4


def unzipped(content: pa.BinaryScalar) -> bytes:
    """A file's bytes, out of gzip if it is gzipped."""
    data = content.as_buffer()
    return gzip.decompress(data) if data.slice(0, min(2, data.size)).to_pybytes() == b"\x1f\x8b" else data.to_pybytes()


_FIELDS = {
    "type": "warc-type",
    "record_id": "warc-record-id",
    "origin": "warc-segment-origin-id",
    "number": "warc-segment-number",
    "total": "warc-segment-total-length",
    "page_id": "x-page-id",
    "url": "warc-target-uri",
    "digest": "warc-payload-digest",
    "payload_length": "x-payload-length",
    "refers_to": "x-refers-to-page-id",
}
_LONGS = ("number", "total", "page_id", "payload_length", "refers_to")
_SCHEMA = ", ".join(f"{k} {'long' if k in _LONGS else 'string'}" for k in _FIELDS) + ", block binary"


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(k, pa.int64() if k in _LONGS else pa.string()) for k in _FIELDS] + [("block", pa.binary())])
    for batch in batches:
        for content in batch.column(0):
            rows, size = [], 0
            for fields, block in parse(unzipped(content)):
                got = {k: fields.get(name) for k, name in _FIELDS.items()}
                rows.append({k: int(v) if k in _LONGS and v is not None else v for k, v in got.items()} | {"block": block})
                size += len(block)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives in path, as it stands: its fields, and its block."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    return files.mapInArrow(_reader, _SCHEMA)


def _payload(block: bytes) -> bytes:
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep:
        raise ValueError("no HTTP head")
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head.replace(b"\r", b"")) else body


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
        + [("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
    )
    for batch in _pieces(batches):
        rows = []
        for r in batch.to_pylist():
            digest = (r["digest"] or "").removeprefix("sha1:")
            payload = None
            if r["type"] == "response":
                numbers = [s["number"] for s in r["segments"]]
                if numbers != list(range(1, len(numbers) + 1)):
                    raise ValueError(f"segments {numbers} of {r['record_id']}")
                block = b"".join(s["block"] for s in r["segments"])
                if len(numbers) > 1 and r["whole"] != len(block):
                    raise ValueError(f"{r['record_id']} has {len(block)} bytes, not {r['whole']}")
                payload = _payload(block)
                if base32_sha1(payload) != digest:
                    raise ValueError(f"the payload of {r['record_id']} does not have its digest")
            n = len(payload) if payload is not None else r["payload_length"]
            rows.append([r["page_id"], r["url"], r["type"], r["refers_to"], digest, n, payload])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Logical records: page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload (null for a revisit).

    Only records in segments are shuffled.  A missing or repeated segment, a wrong total
    length, torn framing or a wrong digest is an error, not a dropped row.
    """
    found = read_records(spark, path)
    keys = ["type", "page_id", "url", "digest", "payload_length", "refers_to"]
    part = F.struct(F.coalesce("number", F.lit(1).cast("long")).alias("number"), "block")
    whole = found.where("number is null and origin is null").select("record_id", *keys, F.array(part).alias("segments"), F.col("total").alias("whole"))
    pieces = found.where("number is not null or origin is not null").withColumn("_id", F.coalesce("origin", "record_id"))
    joined = pieces.groupBy("_id").agg(
        *[F.max(F.when(F.col("origin").isNull(), F.col(k))).alias(k) for k in keys],
        F.array_sort(F.collect_list(part)).alias("segments"),
        F.max("total").alias("whole"),
    )
    joined = joined.select(F.col("_id").alias("record_id"), *keys, "segments", "whole")
    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
    return whole.unionByName(joined).mapInArrow(_decode, schema)
