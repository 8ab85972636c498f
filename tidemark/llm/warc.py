"""WARC archives with the index first.

Writing makes archives of gzip members, one for each record, and an index row for each record with its file,
offset, length, URL and digest. Reading selects rows of the index, deals them out by file and stretch of a file,
sorts them by offset and joins neighbouring records to one read; nothing else of an archive is read.

Of records with equal payloads of at least `LEAST` bytes, that with the largest page_id is a response and the
others revisit it. Payloads count as equal if length and SHA-1 are. Archives go to the shared folder through
pyarrow's file systems; a task's file carries its attempt, so that a task that runs again never writes to a file
that the index names.

Defined cases: null html is an empty payload; a null page_id stays null, is a response only if its group has no
other id, and is never referred to; rows that repeat the largest page_id are all responses; a null url gives no
WARC-Target-URI; an empty table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, written

LEAST = 1000
#: Bytes after which an archive ends, that a read may cover, and that it may skip to join two records.
ARCHIVE, READ, GAP = 1 << 30, 8 << 20, 64 << 10
#: Bytes of an archive that one key of the reading shuffle covers, and that one task reads.
STRETCH, TASK = 16 << 20, 64 << 20
DATE = "2000-01-01T00:00:00Z"

INDEX = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def decided(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """The pages with payload_bytes, payload_digest and refers_to (null: a response)."""
    html = F.coalesce("html", F.lit(""))
    known = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html.cast("binary")).alias("payload_digest"))
    groups = known.filter(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1")
    # written, so that its size is known and Spark broadcasts it only where it is small
    groups = written(groups.drop("n"), "payloads")
    met = known.join(groups, ["payload_digest", "payload_bytes"], "left")
    return met.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))).drop("keeper")


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """The fields of a record; the payload is None for a revisit. A response's payload must have its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    digest, kind = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex(), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} isn't what was written")
    number = lambda x: None if x is None or x[10:-1] == "null" else int(x[10:-1])
    return {"page_id": number(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(fields.get("WARC-Refers-To")), "payload": payload if kind == "response" else None}


def write_archives(pages: DataFrame, folder: str | None = None, least: int = LEAST, level: int = 6) -> DataFrame:
    """Writes the archives to a folder (default: a new one in the shared folder); returns the index as a table."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    columns = ["page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        task, out, n, at = TaskContext.get(), None, 0, 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, size, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                    if out is None or at >= ARCHIVE:
                        if out is not None:
                            out.close()
                        name, at, n = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{n:04d}.warc.gz", 0, n + 1
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    made = zlib.compressobj(level, zlib.DEFLATED, 31)
                    data = made.compress(record(page_id, url, html.encode(), digest, refers_to)) + made.flush()
                    out.write(data)
                    rows.append((page_id, url, size, digest, "response" if refers_to is None else "revisit", refers_to, name, at, len(data)))
                    at += len(data)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()], strict=True)], names=[c.split()[0] for c in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    index = decided(pages, least).select(*columns).mapInArrow(write, INDEX)
    return written(index.withColumn("file", F.concat(F.lit(folder + "/"), "file")), "warc-index")


def read_records(selected: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the selected index rows, read from the archives."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict = {}

        def fetch(file: str, start: int, end: int) -> bytes:
            if file not in files:
                for f in files.values():
                    f.close()
                files.clear()
                fs, path = pyarrow.fs.FileSystem.from_uri(file)
                files[file] = fs.open_input_file(path)
            return files[file].read_at(end - start, start)

        for batch in batches:
            spans = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length", "url")), strict=True))
            k = 0
            while k < len(spans):
                j, (file, start, length, _) = k + 1, spans[k]
                end = start + length
                while j < len(spans) and spans[j][0] == file and 0 <= spans[j][1] - end <= GAP and spans[j][1] + spans[j][2] - start <= READ:
                    end, j = spans[j][1] + spans[j][2], j + 1
                data, rows = fetch(file, start, end), []
                for _, at, size, url in spans[k:j]:
                    rows.append(parsed(zlib.decompress(data[at - start : at - start + size], 31)) | {"url": url})
                    if not with_payload:
                        rows[-1]["payload"] = None
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]))
                k = j

    dealt = selected.select("file", "offset", "length", "url").withColumn("stretch", F.floor(F.col("offset") / STRETCH))
    # so many tasks that each reads about `TASK` bytes, but none of the cores has nothing to do
    parts = max(selected.sparkSession.sparkContext.defaultParallelism, -(-(selected.agg(F.sum("length")).first()[0] or 0) // TASK))
    return dealt.repartition(parts, "file", "stretch").sortWithinPartitions("file", "offset").mapInArrow(read, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    return read_records(write_archives(pages), with_payload=False).drop("payload")
