"""WARC archives: written with an index, read back by coalesced byte ranges of the index.

A record is a gzip member of its own, as in ``.warc.gz`` files. Each task
writes one archive and gives the index row of each record: file, offset,
length, url, digest. A file's name has the task's attempt in it and the rows of
an attempt name its own file, so a task that runs again leaves an orphan at
most, never a wrong index. The index is written before anything is read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_uneven, shared_path, small_enough, text_or_empty, written

#: Payloads below this many bytes are never revisits.
LEAST = 100
#: Reads are joined across gaps of at most this many bytes, up to a range of so many.
GAP, RANGE = 64 * 1024, 8 * 1024 * 1024
#: Archive bytes that a reading task is given, about.
TASK_BYTES = 64 * 1024 * 1024

INDEX = "page_id long, url string, digest string, record_type string, file string, offset long, length long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
_INDEX = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def _open(folder: str):
    """The file system of a folder's URI, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if re.match(r"\w+:", folder) else f"file://{folder}")  # a bare path must be a folder that all executors have mounted


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC record; a revisit has the payload's digest and length, not the payload."""
    name = "" if page_id is None else str(page_id)
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}|{url}|{digest}')}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url)}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Page-Id: {name}", f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The row of a record; raises ValueError if a response's payload isn't the one that its header tells of."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    field = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    body = rest[: int(field["Content-Length"])]
    digest = field["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = field["WARC-Type"]
    whole = kind != "response" or hashlib.sha256(body).hexdigest() == digest and int(field["X-Payload-Length"]) == len(body)
    if lines[0] != "WARC/1.1" or rest[len(body) :] != b"\r\n\r\n" or not whole:
        raise ValueError(f"broken WARC record of page {field.get('X-Page-Id')}")
    number = lambda s: int(s) if s else None
    return {
        "page_id": number(field["X-Page-Id"].strip()), "url": field["WARC-Target-URI"], "record_type": kind, "refers_to": number(field.get("X-Refers-To-Page")),
        "payload_digest": digest, "payload_bytes": int(field["X-Payload-Length"]), "payload": body if kind == "response" else None,
    }


def _gzip(raw: bytes) -> bytes:
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def with_references(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``: which page a row's payload is kept with, null if with itself.

    Only digests that several rows share are joined to the rows. They are
    counted beforehand: if they are too many to broadcast, payloads move once,
    dealt by digest, but for those of hot digests, which stay where they are.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), text_or_empty("html").cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    groups = rows.filter(F.length("payload") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    shared = written(groups.filter("n > 1 and first is not null"), "shared-digests")
    if small_enough(shared):
        met = rows.join(F.broadcast(shared.drop("n")), "digest", "left")
    else:
        met = join_uneven(rows, shared, "digest", shared.agg(F.sum("n")).first()[0], "left")
    # short payloads are kept each with their own row, whatever their digest
    return met.select("page_id", "url", "payload", "digest", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a record for each row of ``pages(page_id, url, html)`` and return the index, itself written.

    Of rows with equal payloads of at least 100 bytes, that with the smallest
    page_id is a response and the others revisit it; rows that repeat this
    page_id are all responses, and rows without a page_id are revisits if a row
    with one exists. A null html is an empty payload, a null url empty. An empty
    table gives an empty index. Other columns are not read. ``folder`` must be
    shared by all executors: a URI that pyarrow opens, or a path.
    """
    folder = folder or shared_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, top = _open(folder)
        name, out, offset = f"part-{TaskContext.get().partitionId():05d}-{TaskContext.get().taskAttemptId()}.warc.gz", None, 0
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if out is None:
                    files.create_dir(top, recursive=True)
                    out = files.open_output_stream(f"{top}/{name}", compression=None)
                rows = []
                for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    raw = _gzip(record(page_id, url, payload, digest, refers_to))
                    out.write(raw)
                    rows.append({"page_id": page_id, "url": url, "digest": digest, "record_type": "response" if refers_to is None else "revisit", "file": name, "offset": offset, "length": len(raw)})
                    offset += len(raw)
                yield pa.RecordBatch.from_pylist(rows, schema=_INDEX)
        finally:
            if out is not None:
                out.close()

    return written(with_references(pages).mapInArrow(run, INDEX).withColumn("folder", F.lit(folder)), "warc-index")


def ranges(rows: list[tuple[int, int]], gap: int = GAP, most: int = RANGE) -> list[list[int]]:
    """Places of sorted ``(offset, length)`` rows, by the read that serves them."""
    out: list[list[int]] = []
    start = end = 0
    for i, (offset, length) in enumerate(rows):
        if out and offset - end <= gap and offset + length - start <= most:
            out[-1].append(i)
        else:
            out.append([i])
            start = end = offset
        end = max(end, offset + length)
    return out


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that the rows of ``index`` name, checked against their digests.

    Rows are dealt by file and stretch of ``RANGE`` bytes, so that a large file
    is many tasks' work, and sorted; neighbours are read at once. Any selection
    of index rows will do; a row that comes twice is read twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        for batch in batches:
            rows = batch.to_pylist()
            at = 0
            while at < len(rows):
                key = (rows[at]["folder"], rows[at]["file"])
                till = at
                while till < len(rows) and (rows[till]["folder"], rows[till]["file"]) == key:
                    till += 1
                part = rows[at:till]
                at = till
                if key not in opened:
                    for f in opened.values():
                        f.close()
                    files, top = _open(key[0])
                    opened = {key: files.open_input_file(f"{top}/{key[1]}")}
                for run_of in ranges([(r["offset"], r["length"]) for r in part]):
                    first = part[run_of[0]]["offset"]
                    end = max(part[i]["offset"] + part[i]["length"] for i in run_of)
                    data = opened[key].read_at(end - first, first)
                    found = [parse(zlib.decompress(data[(at_ := part[i]["offset"] - first) : at_ + part[i]["length"]], 31)) for i in run_of]
                    if not payloads:
                        found = [r | {"payload": None} for r in found]
                    yield pa.RecordBatch.from_pylist(found, schema=_RECORD)
        for f in opened.values():
            f.close()

    # index rows are small beside what they name: tasks are counted by the bytes to be read
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).collect()[0][0]
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-int(total) // TASK_BYTES))
    dealt = index.select("folder", "file", "offset", "length").withColumn("stretch", F.floor(F.col("offset") / RANGE))
    dealt = dealt.repartition(tasks, "folder", "file", "stretch").sortWithinPartitions("folder", "file", "offset").drop("stretch")
    return dealt.mapInArrow(run, RECORD)
