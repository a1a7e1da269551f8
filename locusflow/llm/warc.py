"""WARC archives: a writer of one gzip member a record, and a splittable reader.

Files are cut into byte ranges, whatever stands there.  A task scans its range
for the gzip magic, takes a place for a member only if inflating it gives a
WARC header, and owns the records whose member starts inside its range; the
last one is read to its end beyond the range.  After a record the next member
starts where the last one ended, so scanning is only needed at the start of a
range and after damage.  One record at a time is in memory.

Files are opened through pyarrow's file systems by URI (file, hdfs, s3, gs), in
the folder that the session names in spark.checkpoint.dir.  A writing task
makes one file with a name of its own; only files in the manifest that the
finished job returns count, so tasks may be lost, repeated or run twice.

A record that repeats an earlier payload is a revisit: headers alone, with the
payload's digest and length and the record it refers to.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

MAGIC = b"\x1f\x8b\x08"
#: Bytes inflated to see whether a candidate member is a record.
HEAD = 512
CHUNK = 1 << 20
#: Bytes given to the decompressor at a time.
FEED = 1 << 14
#: Writing tasks whose rows of the manifest share a file.
LISTED = 64
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, path string, at long, stored_bytes long, intact boolean"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _id(page: int | None) -> str:
    return f"<urn:x-page:{'null' if page is None else page}>"


def _page(value: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", value or "")
    return int(found[1]) if found else None


def _plain(value: str) -> str:
    """A header value without controls or line ends."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None, revisit: bool) -> bytes:
    """An uncompressed WARC record with an HTTP response block; of a revisit only the block's headers are kept."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_id(page)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_plain(url)}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_id(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """data as one gzip member in which no later byte looks like the start of a record."""
    for strategy in (zlib.Z_DEFAULT_STRATEGY, zlib.Z_HUFFMAN_ONLY, zlib.Z_FIXED):
        z = zlib.compressobj(level, zlib.DEFLATED, 31, 8, strategy)
        out = z.compress(data) + z.flush()
        at = out.find(MAGIC, 1)
        while at >= 0 and not is_record(out[at : at + HEAD]):
            at = out.find(MAGIC, at + 1)
        if at < 0:
            break
    return out


def is_record(head: bytes) -> bool:
    """Whether bytes at a gzip magic inflate to the start of a WARC record."""
    try:
        return zlib.decompressobj(31).decompress(head, 64).startswith(b"WARC/1.")
    except zlib.error:
        return False


def opened(path: str):
    """The file system and path for a URI or a plain path."""
    return pafs.FileSystem.from_uri(path if re.match(r"\w+:/", path) else f"file://{path}")


def write(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write a record for each row into ``folder`` and return the manifest (path, bytes, records).

    Of rows with equal payloads of at least least_bytes bytes the one with the
    largest id is stored, the others become revisits of it; rows that share
    that id are all stored.  A null payload is an empty one; rows with a null
    id are revisits if any equal payload has an id, else stored.
    """
    spark = shared.session(pages)
    folder = folder or shared.fresh_path(spark, "warc")
    where, path = opened(folder)
    where.create_dir(path, recursive=True)
    body = F.encode(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumn("sha", F.sha1("body"))
    # Only payloads that stand more than once need a join; those rows are few or, in a hot payload, split by the join.
    same = rows.where(F.octet_length("body") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("sha").alias("again"), "last")
    rows = rows.join(same, F.col("sha") == F.col("again"), "left").withColumn("revisit", F.coalesce(F.col("page_id") < F.col("last"), F.col("page_id").isNull() & F.col("last").isNotNull(), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, at = opened(folder)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        size = count = 0
        with to.open_output_stream(f"{at}/{name}", compression=None) as out:
            for batch in batches:
                for page, url, payload, last, revisit in zip(*(batch[c] for c in ("page_id", "url", "body", "last", "revisit")), strict=True):
                    payload, page = payload.as_py(), page.as_py()
                    data = member(record(page, url.as_py(), payload, digest(payload), last.as_py(), revisit.as_py()))
                    out.write(data)
                    size += len(data)
                    count += 1
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size]), pa.array([count])], ["path", "bytes", "records"])

    made = rows.select("page_id", "url", "body", "last", "revisit").mapInArrow(run, "path string, bytes long, records long")
    # A row a task: of one row, the task's number alone decides where it goes, so a task run again replaces its own.
    return shared.written(made.repartition(-(-int(spark.conf.get("spark.sql.shuffle.partitions")) // LISTED)), "manifest")


def _headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def scan(file, start: int, end: int) -> Iterator[tuple[int, int, bytes]]:
    """(place, stored bytes, data) of the records whose member starts in [start, end).

    The range is read once, in steps; what is read beyond a member is kept for
    the next one.
    """
    step = min(CHUNK, max(1 << 16, (end - start) // 8))
    file.seek(start)
    base, at, held = start, start, bytearray()

    def more() -> bytes:
        data = file.read(step)
        held.extend(data)
        return data

    while at < end:
        found = held.find(MAGIC, at - base)
        if found < 0:
            at = max(at, base + len(held) - len(MAGIC) + 1)
            del held[: at - base]
            base = at
            if not more():
                return
            continue
        at = base + found
        if at >= end:
            return
        if found > step:
            del held[:found]
            base = at
        while len(held) - (at - base) < HEAD and more():
            pass
        after = None
        if is_record(bytes(held[at - base : at - base + HEAD])):
            z, out, to = zlib.decompressobj(31), [], at - base
            try:
                while not z.eof:
                    part = bytes(held[to : to + FEED])
                    if not part:
                        if not more():
                            break  # the member is cut off
                        continue
                    out.append(z.decompress(part))
                    to += len(part)
                if z.eof:
                    after = base + to - len(z.unused_data)
            except zlib.error:
                pass
        if after is None:
            at += 1
            continue
        yield at, after - at, b"".join(out)
        at = after


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes, bool]:
    """WARC headers, HTTP headers, payload, and whether the lengths hold."""
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = _headers(head)
    length = int(warc.get("content-length", "0") or 0)
    block = rest[:length]
    http_head, cut, payload = block.partition(b"\r\n\r\n")
    if not cut or not warc.get("content-type", "").startswith("application/http"):
        return warc, {}, block, len(block) == length
    return warc, _headers(http_head), payload, len(block) == length


def read(files: DataFrame, *, split_bytes: int = 32 << 20, with_payload: bool = False) -> DataFrame:
    """The records of WARC files (rows path, bytes), read by byte ranges of about split_bytes each.

    A task gets about split_bytes, in several ranges where files are small.
    ``intact`` is false where a length or digest does not hold.  with_payload
    adds the payload as binary.  Empty files give nothing; damaged members are
    skipped up to the next one that is whole.
    """
    spark = shared.session(files)
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("end"))
    total = ranges.agg(F.sum(F.col("end") - F.col("start"))).first()[0] or 0
    ranges = ranges.repartition(max(1, min(-(-total // split_bytes), 100_000)))
    schema = RECORD + ", payload binary" * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
        types = [kinds[x.split()[1]] for x in schema.split(", ")]

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                where, at = opened(path)
                rows, held = [], 0
                with where.open_input_file(at) as file:
                    for place, stored, data in scan(file, start, end):
                        warc, http, payload, whole = parse(data)
                        kind, sha = warc.get("warc-type"), warc.get("warc-payload-digest", "").removeprefix("sha1:")
                        if kind == "revisit":
                            size = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
                        else:
                            size, made = len(payload), digest(payload)
                            whole &= sha in ("", made) and http.get("content-length", str(size)) == str(size)
                            sha = made
                        rows.append((_page(warc.get("warc-record-id")), warc.get("warc-target-uri"), kind, _page(warc.get("warc-refers-to")), size, sha, path, place, stored, whole, *([payload] if with_payload else [])))
                        held += len(payload) if with_payload else 200
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return ranges.mapInArrow(run, schema)


def op1_warc(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages as WARC and read the archives back."""
    return read(write(pages), split_bytes=4 << 20).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), s AS (
  SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS sha, max(page_id) OVER (PARTITION BY body) AS last FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha, 1 + 5 * (i // 4)::INTEGER, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM s
"""
