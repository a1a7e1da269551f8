"""Block-gzipped SAM files, one for each bucket, in coordinate order.

Tasks compress ranges of the order into part files of whole blocks, through a
data source whose commit lists the parts of the tasks that succeeded, with the
place of each in its bucket's file: the sum of the sizes before it.  Blocks are
gzip members, so a file is its header and parts one after another, and a second
step writes every part at its place, each in a task of its own, into a file that
gets its name when all are there.  No task sees a whole bucket, and a step that
fails leaves no file that can be seen.  Stores that can't be written at a place
take a stream a bucket.

With ``index`` a table beside the files says of every block where it and its
first line start and which positions it holds; a filtered read opens only blocks
whose positions fit (see ``sam``).
"""

from __future__ import annotations

import json
import logging
import os
import struct
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions import records as R
from ..schema import UNMAPPED
from .blocks import END
from .sam import located

log = logging.getLogger(__name__)
#: Text bytes of a block: less than 64 KiB also if it cannot be compressed.
BLOCK = 0xFF00


def level_of(level: int) -> int:
    """A level of zlib; what is none means its default."""
    return level if 0 <= level <= 9 else -1


def block(data: bytes, level: int = 3) -> bytes:
    """One gzip member with its own size in the extra field BC."""
    for at in (level_of(level), 0):
        packer = zlib.compressobj(at, zlib.DEFLATED, -15)
        body = packer.compress(data) + packer.flush()
        if len(body) + 26 <= 1 << 16:
            break
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H2sHH", 6, b"BC", 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def blocks(chunks: Iterator[bytes], level: int = 3) -> Iterator[bytes]:
    held = bytearray()
    for chunk in chunks:
        held += chunk
        while len(held) >= BLOCK:
            yield block(bytes(held[:BLOCK]), level)
            del held[:BLOCK]
    if held:
        yield block(bytes(held), level)


def joined(text: pa.Array) -> tuple[bytes, np.ndarray]:
    """Lines, each with its newline, and their sizes."""
    text = text.cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    size = np.diff(offsets)
    line = np.arange(len(size))
    out = np.full(len(data) + len(size), 10, np.uint8)
    out[np.arange(len(data)) + np.repeat(line, size)] = data
    return out.tobytes(), size + 1


class Part:
    """A part file that is being written, and what its index says of each block."""

    def __init__(self, where: pafs.FileSystem, path: str, level: int):
        self.path, self.level = path, level
        self.out, self.held = where.open_output_stream(path, compression=None), bytearray()
        self.sizes, self.text, self.records, self.marked = [], 0, 0, 0
        self.starts, self.at = [], []

    def add(self, batch: pa.RecordBatch) -> None:
        data, size = joined(batch["text"])
        self.starts.append(self.text + np.cumsum(size) - size)
        self.at.append(batch["at"].to_numpy())
        self.text += len(data)
        self.records += len(size)
        self.marked += int(np.count_nonzero(batch["is_dup"].to_numpy(zero_copy_only=False)))
        self.held += data
        whole = len(self.held) // BLOCK * BLOCK
        for i in range(0, whole, BLOCK):
            self._block(bytes(self.held[i : i + BLOCK]))
        del self.held[:whole]

    def _block(self, data: bytes) -> None:
        made = block(data, self.level)
        self.out.write(made)
        self.sizes.append(len(made))

    def close(self) -> pa.Table:
        """The index: a row for each block in which a line starts, with its place in the part."""
        if self.held:
            self._block(bytes(self.held))
        self.out.close()
        starts, at = np.concatenate([*self.starts, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*self.at, np.zeros(0, np.int64)]).astype(np.int64)
        own = starts // BLOCK
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)])
        last = np.r_[first[1:], len(own)][: len(first)] - 1
        places = np.concatenate(([0], np.cumsum(self.sizes)))
        columns = {"place": places[own[first]], "end": places[own[first] + 1], "first_line": starts[first] % BLOCK, "records": last - first + 1, "first_pos": at[first], "last_pos": at[last]}
        return pa.table({k: pa.array(v.astype(np.int64)) for k, v in columns.items()})


@dataclass
class Written(WriterCommitMessage):
    """The parts of a task: (bucket, number of the task, path, bytes, records, marked records)."""

    parts: list[tuple[str, int, str, int, int, int]]


class PartsWriter(DataSourceArrowWriter):
    """Writes sorted rows (bucket, at, text, is_dup) as parts under a folder; commit lists them in manifest.json, abort leaves nothing."""

    def __init__(self, options: dict):
        self.folder, self.level, self.index = options["path"], int(options["level"]), options["index"] == "true"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, base = located(self.folder)
        where.create_dir(base, recursive=True)
        no, attempt, done, part, bucket = TaskContext.get().partitionId(), uuid.uuid4().hex, [], None, None

        def close() -> None:
            table = part.close()
            if self.index:
                if bucket == UNMAPPED:  # any position may be in any block
                    for name, bound in (("first_pos", -(1 << 63)), ("last_pos", (1 << 63) - 1)):
                        table = table.set_column(table.column_names.index(name), name, pa.array(np.full(table.num_rows, bound)))
                pq.write_table(table, f"{part.path}.index", filesystem=where)
            done.append((bucket, no, part.path, int(sum(part.sizes)), part.records, part.marked))

        for batch in iterator:
            names = batch["bucket"].dictionary_encode()
            codes = names.indices.to_numpy()
            cuts = [*np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]).tolist(), len(codes)] if len(codes) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                name = names.dictionary[int(codes[a])].as_py()
                if name != bucket:
                    if part is not None:
                        close()
                    part, bucket = Part(where, f"{base}/{attempt}-{len(done)}", self.level), name
                part.add(batch.slice(a, b - a))
        if part is not None:
            close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        where, base = located(self.folder)
        where.create_dir(base, recursive=True)
        with where.open_output_stream(f"{base}/manifest.json", compression=None) as out:
            out.write(json.dumps(sorted(p for m in messages if m for p in m.parts)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        where, base = located(self.folder)
        if where.get_file_info(base).type == pafs.FileType.Directory:
            where.delete_dir(base)


class PartsDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bgzf_parts"

    def schema(self) -> str:
        return "bucket string, at long, text string, is_dup boolean"

    def writer(self, schema, overwrite: bool) -> PartsWriter:
        return PartsWriter(self.options)


def placed(parts: Sequence[tuple], head: int) -> list[tuple[str, int, str, int]]:
    """(bucket, place in its file, path, bytes) of the parts, in order; each bucket begins after its header's bytes."""
    at = defaultdict(lambda: head)
    out = []
    for bucket, _, path, size, *_ in parts:
        out.append((bucket, at[bucket], path, size))
        at[bucket] += size
    return out


STEP = 8 << 20


def copied(spark: SparkSession, placement: list[tuple], targets: dict[str, str], index: str | None) -> None:
    """Write each part at its place in its bucket's file, and its index with places in that file; a repeated task writes the same again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                where, _ = located(row["path"])
                with where.open_input_stream(row["path"], compression=None) as part, open(row["target"], "r+b") as out:
                    out.seek(row["place"])
                    while chunk := part.read(STEP):
                        out.write(chunk)
                if index is not None:
                    table = pq.read_table(f"{row['path']}.index", filesystem=where)
                    for i, name in enumerate(("place", "end")):
                        table = table.set_column(i, name, pa.array(table[name].to_numpy() + row["place"]))
                    folder = f"{index}/{row['bucket']}"
                    where.create_dir(folder, recursive=True)
                    pq.write_table(table, f"{folder}/{row['place']:020d}.parquet", filesystem=where)
            yield batch.select(["bucket"])

    rows = [(bucket, place, path, targets[bucket]) for bucket, place, path, _ in placement]
    todo = spark.createDataFrame(rows, "bucket string, place long, path string, target string").repartition(max(1, min(len(rows), 10_000)))
    todo.mapInArrow(run, "bucket string").write.format("noop").mode("overwrite").save()


def _streamed(spark: SparkSession, placement: list[tuple], folder: str, head: bytes, tail: bytes) -> None:
    """A bucket's file as one stream of its parts, where a store can't be written at a place."""

    def join(key: tuple, table: pa.Table) -> pa.Table:
        where, base = located(folder)
        with where.open_output_stream(f"{base}/{key[0].as_py()}.gz", compression=None) as out:
            out.write(head)
            for _, path in sorted(zip(table["place"].to_pylist(), table["path"].to_pylist(), strict=True)):
                with where.open_input_stream(path, compression=None) as part:
                    while chunk := part.read(STEP):
                        out.write(chunk)
            out.write(tail)
        return pa.table({"bucket": [key[0].as_py()]})

    rows = spark.createDataFrame([p[:3] for p in placement], "bucket string, place long, path string")
    rows.groupBy("bucket").applyInArrow(join, "bucket string").write.format("noop").mode("overwrite").save()


def write_buckets(rows: DataFrame, header: Sequence[str], folder: str, *, level: int = 3, end_block: bool = False, by_name: bool = False, index: bool = False) -> DataFrame:
    """Write marked records (bucket, line, flag, is_dup, pos, line_no) to ``folder``/<bucket>.gz; returns (bucket, path, records, duplicates).

    Unmapped records stay in input order; by_name sorts the others by name key,
    without an index.  The counts are those of the pass that writes.
    """
    index = index and not by_name
    spark = rows.sparkSession
    spark.dataSource.register(PartsDataSource)
    text = F.when(F.col("is_dup"), R.duplicate_line(F.col("line"), F.col("flag"))).otherwise(F.col("line"))
    key = F.when(F.col("bucket") == UNMAPPED, F.lit(0).cast("long")).otherwise(R.name_key(F.col("qname")) if by_name else F.col("pos"))
    # Texts are made after the shuffle: what comes before it is run twice, as bounds are sampled.
    lines = rows.select("bucket", key.alias("at"), "line_no", "line", "flag", "is_dup")
    ordered = lines.repartitionByRange("bucket", "at", "line_no").sortWithinPartitions("bucket", "at", "line_no").select("bucket", "at", text.alias("text"), "is_dup")
    staged = f"{folder.rstrip('/')}/.parts-{uuid.uuid4().hex}"
    where, base = located(folder)
    where.create_dir(base, recursive=True)
    ordered.write.format("bgzf_parts").mode("append").options(level=level, index=str(index).lower()).save(staged)
    _, at = located(staged)
    with where.open_input_stream(f"{at}/manifest.json", compression=None) as file:
        parts = json.loads(file.read())
    for bucket, no, _, size, records, marked in sorted(parts, key=lambda p: p[1]):
        log.debug("task %d: %d records of %s, %d duplicates, %d bytes", no, records, bucket, marked, size)
    head, tail = b"".join(blocks(iter(["".join(x + "\n" for x in header).encode()]), level)), END if end_block else b""
    placement = placed(parts, len(head))
    made = defaultdict(lambda: [0, 0])
    for bucket, _, _, _, records, marked in parts:
        made[bucket] = [made[bucket][0] + records, made[bucket][1] + marked]
    if isinstance(where, pafs.LocalFileSystem):
        targets = {bucket: f"{base}/.{bucket}-{uuid.uuid4().hex}" for bucket in made}
        size = {bucket: place + n for bucket, place, _, n in placement}  # of the last part
        for bucket, target in targets.items():
            with open(target, "wb") as out:
                out.write(head)
                out.seek(size[bucket])
                out.write(tail)
                out.truncate()
        copied(spark, placement, targets, f"{base}/.index" if index else None)
        for bucket, target in targets.items():
            os.replace(target, f"{base}/{bucket}.gz")
    else:
        _streamed(spark, placement, folder, head, tail)
    where.delete_dir(at)
    return spark.createDataFrame([(b, f"{base}/{b}.gz", *n) for b, n in sorted(made.items())], "bucket string, path string, records long, duplicates long")
