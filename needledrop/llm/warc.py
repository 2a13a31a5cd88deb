"""WARC records as a chunked record table."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needledrop.llm.common import bounded_batches, column_of, shared_folder, written

CHUNKS = "archive int, record long, chunk int, chunks int, data binary"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


#: Largest table of repeated payloads that is broadcast, in rows of a digest and two numbers.
BROADCAST_ROWS = 200_000


def header(page_id: int | None, url: str, kind: str, size: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """Everything of a record before its payload: the WARC fields and the HTTP head."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", name(page_id)), ("WARC-Date", date)]
    if url:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + (size if kind == "response" else 0)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + http


def parse(start: bytes) -> tuple[dict[str, str], int, int]:
    """WARC fields, payload size that the HTTP head tells, and where the payload begins."""
    end = start.index(b"\r\n\r\n")
    lines = start[:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    body = start.index(b"\r\n\r\n", end + 4)
    http = dict(line.split(": ", 1) for line in start[end + 4 : body].decode().split("\r\n")[1:])
    return fields, int(http["Content-Length"]), body + 4


def heads(piece: memoryview) -> bytes:
    """A beginning of a record's first chunk that holds both heads, however long they are."""
    n = 1 << 16
    while True:
        start = bytes(piece[:n])
        end = start.find(b"\r\n\r\n")
        if n >= len(piece) or (end >= 0 and start.find(b"\r\n\r\n", end + 4) >= 0):
            return start
        n *= 4


def write_archives(pages: DataFrame, path: str, chunk_bytes: int = 1 << 20, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes a record for each row of pages (page_id, url, html) to the chunk table at path.

    The bytes of the chunks of an archive in the order of (record, chunk) are a WARC/1.1 file. A chunk has at most
    chunk_bytes of payload, so no record is ever one piece of memory beyond its own input. Payload: html in UTF-8.

    Of records with equal payloads (SHA-1 and size) of at least least_bytes bytes the one with the smallest page_id is the
    response, the others revisit it and have no payload; the rest are responses. Which payloads repeat is an aggregate of
    digests, a written table of the repeated ones. Up to BROADCAST_ROWS of these go to every task, and no payload is
    shuffled; more meet the payloads by a join on the digest.

    Null html: the empty payload. Null url: no target field. Null page_id: never referred to unless all equal payloads
    have none; then all of these are responses. Rows of the same smallest page_id are all responses. An empty table
    gives no record. Other columns are ignored.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = bounded_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.unhex(F.sha1("payload")), "size": F.octet_length("payload").cast("long")})
    seen = rows.where(F.col("size") >= least_bytes).groupBy(F.col("digest").alias("d"), F.col("size").alias("s")).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    twice = written(seen.where("n > 1 and first is not null").drop("n"), "repeated-payloads")
    few = twice.count() <= BROADCAST_ROWS
    marked = rows.join(F.broadcast(twice) if few else twice, (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s")), "left")
    marked = marked.select("page_id", "url", "payload", "digest", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        archive, record = TaskContext.get().partitionId(), 0
        out: list[tuple[int, int, int, bytes]] = []
        held = 0
        for batch in batches:
            payloads = column_of(batch, "payload")
            others = [column_of(batch, c).to_pylist() for c in ("page_id", "url", "digest", "refers_to")]
            for i, (page_id, url, digest, first) in enumerate(zip(*others, strict=True)):
                body = memoryview(payloads[i].as_buffer())
                kind = "response" if first is None else "revisit"
                start = header(page_id, url or "", kind, len(body), base64.b32encode(digest).decode(), first, date)
                cuts = range(0, len(body), chunk_bytes) if kind == "response" else ()
                n = max(1, len(cuts))
                for k in range(n):
                    piece = bytes(body[k * chunk_bytes : (k + 1) * chunk_bytes]) if kind == "response" else b""
                    out.append((record, k, n, (start if k == 0 else b"") + piece + (b"\r\n\r\n" if k == n - 1 else b"")))
                    held += len(out[-1][3])
                    if held >= 4 << 20:
                        yield _chunk_rows(archive, out)
                        out, held = [], 0
                record += 1
        if out:
            yield _chunk_rows(archive, out)

    marked.mapInArrow(run, CHUNKS).write.option("compression", "zstd").parquet(path)


def _chunk_rows(archive: int, rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    record, chunk, chunks, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), archive, np.int32)), pa.array(record, pa.int64()), pa.array(chunk, pa.int32()), pa.array(chunks, pa.int32()), pa.array(data, pa.binary())], names=["archive", "record", "chunk", "chunks", "data"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record at path.

    Records of one chunk are read where they lie. Those of several are sorted by chunk within a partition and their
    digest is carried from chunk to chunk; no record is put together. A payload that differs from its recorded digest or
    size raises ValueError. A revisit has the digest and size of the full payload in its record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, out = None, []
        for batch in batches:
            data = column_of(batch, "data")
            for i, (chunk, chunks) in enumerate(zip(column_of(batch, "chunk").to_pylist(), column_of(batch, "chunks").to_pylist(), strict=True)):
                piece = memoryview(data[i].as_buffer())
                if chunk == 0:
                    fields, size, at = parse(heads(piece))
                    state = (fields, size, hashlib.sha1(usedforsecurity=False))
                    piece, read = piece[at:], 0
                last = chunk == chunks - 1
                piece = piece[:-4] if last else piece
                fields, size, digest = state
                digest.update(piece)
                read += len(piece)
                if last:
                    out.append(_record(fields, size, read, digest))
            if len(out) > 5_000:
                yield _records(out)
                out = []
        if out:
            yield _records(out)

    table = spark.read.schema(CHUNKS).parquet(path)
    short = table.where("chunks = 1").select("chunk", "chunks", "data").mapInArrow(run, RECORDS)
    long = table.where("chunks > 1").repartition("archive", "record").sortWithinPartitions("archive", "record", "chunk")
    return short.union(long.select("chunk", "chunks", "data").mapInArrow(run, RECORDS))


def _record(fields: dict[str, str], size: int, read: int, digest) -> tuple:
    number = lambda name: int(x) if (x := fields[name].removeprefix("<urn:page:").removesuffix(">")) else None
    told, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response":
        found = base64.b32encode(digest.digest()).decode()
        if found != told or read != size:
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} isn't as recorded")
    return number("WARC-Record-ID"), fields.get("WARC-Target-URI"), size, told, kind, number("WARC-Refers-To") if kind == "revisit" else None


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in RECORDS.split(", ")])


def round_trip(pages: DataFrame, chunk_bytes: int = 1 << 20, least_bytes: int = 0) -> DataFrame:
    """Writes the archives of pages to a new folder in the shared one and reads them back."""
    path = shared_folder(pages.sparkSession, "warc")
    write_archives(pages, path, chunk_bytes, least_bytes)
    return read_archives(pages.sparkSession, path)


#: What op7_warc gives, for DuckDB. Five hexadecimal digits make four digits in base 32.
SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY h, payload_bytes) AS lowest FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST(1 + ((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN lowest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN lowest <> page_id THEN lowest END AS refers_to
FROM f
"""
