"""WARC archives through a chunked record table.

A payload travels as rows ``(record, chunk_no, data)`` of at most ``chunk_bytes``. Each row carries the SHA-256 and the
length of the payload up to its end, so the last row has the whole payload's figures and no step holds a record in
memory. Writers stream the rows of a partition into archive files in the shared folder; readers stream them back.

Archive names are fresh for every task attempt, and the manifest lists only the files of attempts that succeeded, so a
repeated or speculative task leaves at most unlisted files.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import sys
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from webquire.llm.common import bounded_batches, flush
from webquire.session import cut, work_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_BYTES = 1 << 20
ARCHIVE_BYTES = 1 << 28
# Payloads below this size are stored every time.
REVISIT_BYTES = 100

# end, sha256: length and digest of the payload up to the end of this row's data
CHUNKS = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
    "chunk_no int, data binary, end long, sha256 string, last boolean"
)
MANIFEST = "archive string, n_records long, n_bytes long"
# Each record is a gzip member of its own, as readers of archives expect.
GZIP_LEVEL = 6
FLUSH_BYTES = 8 << 20
FLUSH_ROWS = 2_000
EOL = b"\r\n"


def revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, html, payload_bytes, payload_digest, record_type, refers_to``: which records repeat an earlier payload.

    The response is the record with the smallest id among equal payloads of ``REVISIT_BYTES`` or more. Rows that share
    that id are all responses; rows with a null id are revisits if any id is known, else responses.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    keyed = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(F.encode(html, "UTF-8"), 256).alias("payload_digest"))
    found = (
        keyed.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy(F.col("payload_digest").alias("__d"))
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 and first_id is not null").drop("n")
    )
    first = cut(found, "warc-first")  # a plain table on this side lets adaptive execution split a hot payload
    repeats = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return keyed.join(first, F.col("payload_digest") == F.col("__d"), "left").select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(repeats, "revisit").otherwise("response").alias("record_type"), F.when(repeats, F.col("first_id")).alias("refers_to"),
    )


def record_chunks(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk rows of ``revisits``' records, those of a record together and in order. A revisit has one row without data."""
    arrow = to_arrow_schema(StructType.fromDDL(CHUNKS))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            meta = zip(*(batch.column(c).to_pylist() for c in arrow.names[:6]))
            for own, html in zip(meta, batch.column("html")):
                view = memoryview(html.as_buffer() if own[2] == "response" else b"")
                digest = hashlib.sha256()
                for no, start in enumerate(range(0, max(1, len(view)), chunk_bytes)):
                    data = bytes(view[start : start + chunk_bytes])
                    digest.update(data)
                    rows.append((*own, no, data, start + len(data), digest.hexdigest(), start + chunk_bytes >= len(view)))
                    held += len(data)
                    if held >= FLUSH_BYTES or len(rows) >= FLUSH_ROWS:
                        held = 0
                        yield from flush(rows, arrow)
        yield from flush(rows, arrow)

    return records.mapInArrow(cut_up, CHUNKS)


def _head(page_id: int | None, url: str | None, record_type: str, refers_to: int | None, size: int, digest: str) -> bytes:
    """The record's header and the HTTP header that opens its block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = [
        "WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2026-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(http) + (size if record_type == 'response' else 0)}",
    ]
    if record_type == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + 2 * EOL + http


def write_archives(chunks: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Stream chunk rows (of a record: together, in order) into archives below ``folder``; the manifest, written once.

    A new archive starts after ``archive_bytes`` (compressed). A payload that does not end in its announced digest fails the task.
    """
    arrow, columns_of = to_arrow_schema(StructType.fromDDL(MANIFEST)), to_arrow_schema(StructType.fromDDL(CHUNKS)).names

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        out, member, name, n, size = None, None, "", 0, 0
        done = []
        for batch in batches:
            for page_id, url, kind, refers_to, total, digest, no, data, end, sha256, last in zip(*(batch.column(c).to_pylist() for c in columns_of)):
                if no == 0:
                    if out is not None and size >= archive_bytes:
                        out.close()
                        done.append((f"{folder}/{name}", n, size))
                        out = None
                    if out is None:
                        store.create_dir(root, recursive=True)
                        name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    member = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
                    size += out.write(member.compress(_head(page_id, url, kind, refers_to, total, digest)))
                size += out.write(member.compress(data))
                if last:
                    if kind == "response" and (end, sha256) != (total, digest):
                        raise ValueError(f"the payload of page {page_id} changed while it was written")
                    size += out.write(member.compress(2 * EOL) + member.flush())
                    n += 1
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", n, size))
        yield from flush(done, arrow)

    return cut(chunks.mapInArrow(write, MANIFEST), "warc-manifest")


def _lines(stream: io.BufferedReader, first: bytes) -> dict[str, str]:
    """The header that follows the line ``first``, by lower-cased name."""
    found = {"": first.decode()}
    while (line := stream.readline().rstrip(EOL)) != b"":
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def read_archives(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk rows of the archives that ``manifest`` lists, read as streams: one task at a time per archive.

    A digest that differs from the header's, or an archive cut off inside a record, fails the task.
    """
    arrow = to_arrow_schema(StructType.fromDDL(CHUNKS))

    def chunks(archive: str) -> Iterator[tuple]:
        store, path = fs.FileSystem.from_uri(archive)
        with io.BufferedReader(gzip.GzipFile(fileobj=store.open_input_stream(path, compression=None)), 1 << 16) as stream:
            while first := stream.readline():
                if not (first := first.rstrip(EOL)):
                    continue
                head = _lines(stream, first)
                http = _lines(stream, stream.readline().rstrip(EOL))
                kind, total = head["warc-type"], int(http["content-length"])
                key = re.fullmatch(r"<urn:page:(-?\d*)>", head["warc-record-id"])[1]
                refers = re.fullmatch(r"<urn:page:(-?\d+)>", head.get("warc-refers-to", ""))
                own = (int(key) if key else None, head["warc-target-uri"], kind, int(refers[1]) if refers else None, total, head["warc-payload-digest"].removeprefix("sha256:"))
                left, digest, no, end = total if kind == "response" else 0, hashlib.sha256(), 0, 0
                while True:
                    data = stream.read(min(left, chunk_bytes))
                    digest.update(data)
                    left, end = left - len(data), end + len(data)
                    if left and not data or not left and kind == "response" and digest.hexdigest() != own[5]:
                        raise ValueError(f"{archive}: the record of page {own[0]} is damaged")
                    yield (*own, no, data, end, digest.hexdigest(), not left)
                    no += 1
                    if not left:
                        break

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                for row in chunks(archive):
                    rows.append(row)
                    held += len(row[7])
                    if held >= FLUSH_BYTES or len(rows) >= FLUSH_ROWS:
                        held = 0
                        yield from flush(rows, arrow)
        yield from flush(rows, arrow)

    n = manifest.count()
    return manifest.select("archive").repartition(max(1, n), "archive").mapInArrow(read, CHUNKS)


def warc_round_trip(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` (``page_id, url, html``) and return the chunk table read back from the archives.

    A null html is an empty payload, a null url an empty target. Extra columns are ignored. An empty table writes no
    archive and gives no rows.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    manifest = write_archives(record_chunks(revisits(pages), chunk_bytes), work_path(spark, "warc"), archive_bytes)
    return read_archives(manifest, chunk_bytes)


def record_table(chunks: DataFrame) -> DataFrame:
    """One row per record from its last chunk: the figures of the whole payload, without the payload."""
    return chunks.where("last").select("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", (F.col("chunk_no") + 1).alias("n_chunks"))
