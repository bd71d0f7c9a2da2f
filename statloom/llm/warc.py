"""WARC archives as a chunked record table.

A record is a header and a payload. The archive is a table of rows (record id,
chunk number, bytes) whose chunks, put together in order, are the record in
WARC/1.1 format byte by byte. Payloads are cut as they are written, so an
oversized one never exists as a whole record; every chunk carries the SHA-1 of the
payload up to its end, so a reader checks each chunk as it arrives. Equal
payloads are stored once: the others are revisit records without a payload.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, shared_dir, written

CHUNK_BYTES, LEAST_SHARED = 64 * 1024, 1000
#: Up to this many groups of equal payloads (some 80 bytes each) are broadcast.
BROADCAST_KEPT = 100_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
END = b"\r\n\r\n"
CHUNKS = "record string, chunk int, last boolean, bytes binary, running string"


def header(kind: str, record: str, url: str, digest: bytes, length: int, payload: int, refers_to: str | None, fields: dict[str, str]) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {length}", f"X-Payload-Length: {payload}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"{k}: {v}" for k, v in fields.items()]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + END


def chunks(head: bytes, payload: memoryview | bytes, size: int = CHUNK_BYTES) -> Iterator[tuple[int, bool, bytes, str]]:
    """(number, last, bytes, SHA-1 of the payload so far): the header, then the payload by ``size``, then the end of the record with the last chunk."""
    sha, n = hashlib.sha1(), len(payload)
    if n <= size:
        sha.update(payload)
        yield 0, True, head + bytes(payload) + END, sha.hexdigest()
        return
    yield 0, False, head, sha.hexdigest()
    for i, at in enumerate(range(0, n, size), 1):
        part = payload[at : at + size]
        sha.update(part)
        last = at + size >= n
        yield i, last, bytes(part) + END if last else bytes(part), sha.hexdigest()


def _write(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("record", pa.string()), ("chunk", pa.int32()), ("last", pa.bool_()), ("bytes", pa.binary()), ("running", pa.string())])
    rows, held = [], 0
    for b in batches:
        get = [b.column(c) for c in ("record", "url", "digest", "refers_to", "fields", "html")]
        for record, url, digest, refers, fields, page in zip(*get, strict=True):
            payload = memoryview(page.as_buffer()) if page.is_valid else memoryview(b"")
            revisit = refers.is_valid
            head = header("revisit" if revisit else "response", record.as_py(), " ".join((url.as_py() or "").split()), bytes.fromhex(digest.as_py()), len(HTTP) + (0 if revisit else len(payload)), len(payload), refers.as_py(), dict(fields.as_py()))
            for n, last, part, running in chunks(head + HTTP, memoryview(b"") if revisit else payload, size):
                rows.append((record.as_py(), n, last, part, running))
                held += len(part)
                if held > 32 * size:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


class RecordError(ValueError):
    """A record that does not have the bytes that its header states."""


class Reader:
    """One record, chunk by chunk: its header is kept, its payload only counted and hashed."""

    def __init__(self) -> None:
        self.head, self.fields, self.block, self.sha, self.tail = b"", None, 0, hashlib.sha1(), b""

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            self.head += data
            cut = self.head.find(END)
            if cut < 0:
                return
            lines = self.head[:cut].decode("utf-8", "surrogatepass").split("\r\n")
            self.version, self.fields = lines[0], dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
            data, self.head = self.head[cut + 4 :], b""
            self.skip, self.left = len(HTTP), int(self.fields["Content-Length"])
        take = data[: self.left]
        self.left -= len(take)
        self.tail += data[len(take) :]
        if self.skip:
            drop = min(self.skip, len(take))
            self.skip -= drop
            take = take[drop:]
        self.block += len(take)
        self.sha.update(take)

    def close(self) -> dict[str, str]:
        if self.fields is None or self.left or self.tail != END:
            raise RecordError("the record's length differs from its header")
        stated = base64.b32decode(self.fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        if self.fields["WARC-Type"] == "response" and (stated != self.sha.hexdigest() or self.block != int(self.fields["X-Payload-Length"])):
            raise RecordError(f"the payload of {self.fields['WARC-Record-ID']} differs from its digest")
        return self.fields | {"digest": stated}


def _read(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    names = ["WARC-Record-ID", "WARC-Type", "WARC-Target-URI", "X-Payload-Length", "digest", "WARC-Refers-To", *columns]
    reader, now, want = None, None, 0
    for b in batches:
        out = []
        for record, n, last, data, running in zip(*[b.column(c) for c in ("record", "chunk", "last", "bytes", "running")], strict=True):
            record, n = record.as_py(), n.as_py()
            if n == 0:
                if reader is not None:
                    raise RecordError(f"record {now} has no end")
                reader, now, want = Reader(), record, 0
            if reader is None or record != now or n != want:
                raise RecordError(f"chunk {n} of record {record} is not where it should be")
            want += 1
            reader.feed(data.as_py())
            if reader.sha.hexdigest() != running.as_py():
                raise RecordError(f"chunk {n} of record {record} differs from its digest")
            if last.as_py():
                f = reader.close()
                out.append([f.get(k) for k in names])
                reader = None
        cols = list(zip(*out, strict=True)) if out else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["record", "type", "url", "payload", "digest", "refers_to", *[f"f{i}" for i in range(len(columns))]])
    if reader is not None:
        raise RecordError(f"record {now} has no end")


def records(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """A record per page row: record, url, html, digest (hex SHA-1), refers_to (the record of the equal payload that is kept; null for a response), fields.

    Of equal payloads of ``least`` bytes and more the one with the largest
    page_id is kept (null ids are the least; rows with that same id are all kept).
    Groups of equal payloads are broadcast if there are few, so that payloads are
    not shuffled; else both sides are shuffled by digest.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    name = lambda i, r: F.concat(F.lit("urn:statloom:page:"), F.coalesce(i.cast("string"), F.lit("null")), F.lit(":"), r.cast("string"))
    shared = rows.filter(F.col("size") >= least).groupBy("digest", "size").agg(F.max(F.struct(F.coalesce(F.col("page_id"), F.lit(-(2**63))).alias("i"), (-F.col("row")).alias("r"))).alias("k"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    kept = shared.select(F.col("digest").alias("d_"), F.col("size").alias("s_"), (-F.col("k.r")).alias("kept_row"), F.col("k.i").alias("kept_id"))
    kept = written(kept)
    few = len(kept.limit(BROADCAST_KEPT + 1).select("kept_row").collect()) <= BROADCAST_KEPT
    rows = rows.join(F.broadcast(kept) if few else kept, (F.col("digest") == F.col("d_")) & (F.col("size") == F.col("s_")), "left")
    revisit = F.col("kept_id").isNotNull() & (F.col("kept_id") != F.coalesce(F.col("page_id"), F.lit(-(2**63))))
    ids = F.when(revisit, F.nullif("kept_id", F.lit(-(2**63))).cast("string"))
    fields = F.create_map(F.lit("X-Page-ID"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("X-Refers-To-Page-ID"), F.coalesce(ids, F.lit("")), F.lit("X-URL-Null"), F.col("url").isNull().cast("string"))
    return rows.select(name(F.col("page_id"), F.col("row")).alias("record"), "url", "html", "digest", F.when(revisit, name(F.nullif("kept_id", F.lit(-(2**63))), F.col("kept_row"))).alias("refers_to"), fields.alias("fields"))


def write_archive(recs: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Writes :func:`records` (or rows like them) as a chunk table."""
    map_rows(recs.select("record", "url", "digest", "refers_to", "fields", F.col("html").cast("binary").alias("html")), lambda it: _write(it, chunk_bytes), CHUNKS).write.parquet(path)


def read_archive(spark, path: str, fields: Iterable[str] = ()) -> DataFrame:
    """record, type, url, payload (bytes), digest, refers_to and the header ``fields`` of every record; each chunk and each record is checked on the way.

    Chunks of a record meet in one task in their order, but pass it one at a time.
    """
    fields = list(fields)
    table = spark.read.schema(CHUNKS).parquet(path)
    order = table.repartition("record").sortWithinPartitions("record", "chunk")
    return map_rows(order, lambda it: _read(it, fields), "record string, type string, url string, payload string, digest string, refers_to string" + "".join(f", f{i} string" for i in range(len(fields))))


def export_warc(chunk_rows: Iterable[tuple[bytes]], out) -> int:
    """Writes the chunks of records, in order, to a binary file object; returns the bytes written. The result is a .warc file."""
    return sum(out.write(data) for (data,) in chunk_rows)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages to an archive in the shared folder and reads it back: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload. A null page_id stays null (and refers_to is
    null for a revisit of a record with a null page_id). Repeated rows have a
    record each. White space in a url is one space. Other columns are not kept.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    write_archive(records(pages), path)
    back = read_archive(spark, path, ["X-Page-ID", "X-Refers-To-Page-ID", "X-URL-Null"])
    kind = dict(pages.dtypes)["page_id"]
    num = lambda c: F.nullif(F.col(c), F.lit("")).cast(kind)
    return back.select(num("f0").alias("page_id"), F.when(F.col("f2") == "false", F.col("url")).alias("url"), F.col("payload").cast("long").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), num("f1").alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, url, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT d, n, max(page_id) AS kept FROM p WHERE n >= 1000 GROUP BY d, n)
SELECT page_id, url, p.n::BIGINT AS payload_bytes, p.d AS payload_digest, CASE WHEN kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM p LEFT JOIN k ON p.d = k.d AND p.n = k.n
"""
