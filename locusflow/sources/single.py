"""One file of all buckets in header order: sorted buckets are merged by their block indexes, nothing is sorted again.

A reference's records lie in its own bucket and, with a mate elsewhere, among
the discordant ones; both are in the order of positions.  Runs of blocks of the
former set ranges of positions, and a task merges what both hold of a range,
opening only blocks that meet it, into a part file.  Unmapped records come last,
as runs of blocks that are copied as they are.  Parts then get their places like
those of a bucket.  So discordant blocks are opened once for each reference.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DISCORDANT, UNMAPPED
from . import bgzf, sam

#: Compressed bytes of a bucket that a task merges or copies.
RUN = 64 << 20
FIRST, LAST = -(1 << 63), (1 << 63) - 1


def runs(spark: SparkSession, folder: str, bucket: str, size: int) -> list[tuple[int, int, int]]:
    """(place, end, first position) of stretches of about ``size`` bytes of a bucket's blocks, in order; none without such a bucket."""
    index = f"{folder.rstrip('/')}/.index/{bucket}"
    where, at = sam.located(index)
    if where.get_file_info(at).type != pafs.FileType.Directory:
        return []
    rows = spark.read.parquet(index).groupBy(F.floor(F.col("place") / size).alias("run"))
    found = rows.agg(F.min("place").alias("place"), F.max("end").alias("end"), F.min("first_pos").alias("first_pos")).orderBy("run")
    return [(r["place"], r["end"], r["first_pos"]) for r in found.collect()]  # a row a run


def units(spark: SparkSession, folder: str, references: Sequence[str], size: int) -> list[tuple]:
    """(bucket, least position, position after the greatest, place, end) of what each task makes, in order; of copied runs the places count."""
    out = []
    for name in references:
        cuts = sorted({first for _, _, first in runs(spark, folder, name, size)})[1:]
        out += [(name, a, b, None, None) for a, b in zip([FIRST, *cuts], [*cuts, LAST], strict=True)]
    return out + [(UNMAPPED, None, None, place, end) for place, end, _ in runs(spark, folder, UNMAPPED, size)]


def _records(path: str, tests: list[tuple]) -> Iterator[pa.RecordBatch]:
    """(pos, line) of a bucket's records that pass the tests, in order; of a file that isn't there none."""
    where, at = sam.located(path)
    if where.get_file_info(at).type != pafs.FileType.File:
        return
    reader = sam.PushingReader({"path": path}, ["pos", "line"])
    reader.tests = tests
    for part in reader.partitions():
        yield from reader.read(part)


def merged_batches(one: Iterator[pa.RecordBatch], two: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two streams (pos, line) in order as one; at a time what both have up to the lesser of their batches' ends."""
    a, b = next(one, None), next(two, None)
    while a is not None and b is not None:
        x, y = a["pos"].to_numpy(), b["pos"].to_numpy()
        limit = min(x[-1], y[-1])
        m, n = (int(np.searchsorted(z, limit, "right")) for z in (x, y))
        both = pa.Table.from_batches([a.slice(0, m), b.slice(0, n)]).combine_chunks()
        yield from both.take(pa.array(np.argsort(np.concatenate((x[:m], y[:n])), kind="stable"))).to_batches()
        a = a.slice(m) if m < len(x) else next(one, None)
        b = b.slice(n) if n < len(y) else next(two, None)
    for rest, more in ((a, one), (b, two)):
        if rest is not None:
            yield rest
            yield from more


def single_file(spark: SparkSession, folder: str, header: Sequence[str], target: str, *, level: int = 3, end_block: bool = False, size: int = RUN) -> int:
    """Write the indexed buckets of a folder as one block-gzipped file in coordinate order; returns its number of bytes.

    The file gets its name when it is whole.  It needs a file system that can be
    written at a place.
    """
    where, base = sam.located(target)
    if not isinstance(where, pafs.LocalFileSystem):
        raise ValueError("a single file needs a file system that can be written at a place")
    todo = units(spark, folder, sam.references(list(header)), size)
    staged = f"{target}.parts-{uuid.uuid4().hex}"
    source = folder.rstrip("/")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = sam.located(staged)
        files.create_dir(at, recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                path = f"{at}/{uuid.uuid4().hex}-{TaskContext.get().attemptNumber()}"
                if row["bucket"] == UNMAPPED:
                    length = _copied(files, sam.located(f"{source}/{UNMAPPED}.gz")[1], path, row["place"], row["end"])
                else:
                    length = _merged(files, source, path, row, level)
                yield pa.RecordBatch.from_arrays([pa.array([row["no"]], pa.int64()), pa.array([path]), pa.array([length], pa.int64())], ["no", "path", "bytes"])

    parts = []
    if todo:
        rows = spark.createDataFrame([(no, *unit) for no, unit in enumerate(todo)], "no long, bucket string, least long, after long, place long, end long")
        made: DataFrame = rows.repartition(min(len(todo), 10_000), "no").mapInArrow(make, "no long, path string, bytes long")
        parts = sorted(tuple(r) for r in made.collect())  # a row a unit
    head = b"".join(bgzf.blocks(iter(["".join(x + "\n" for x in header).encode()]), level))
    tail = bgzf.END if end_block else b""
    placement = bgzf.placed([("all", no, path, length) for no, path, length in parts if length], len(head))
    hidden = f"{base}.{uuid.uuid4().hex}"
    total = placement[-1][1] + placement[-1][3] if placement else len(head)
    with open(hidden, "wb") as out:
        out.write(head)
        out.seek(total)
        out.write(tail)
        out.truncate()
    if placement:
        bgzf.copied(spark, placement, {"all": hidden}, None)
    os.replace(hidden, base)
    files, at = sam.located(staged)
    if files.get_file_info(at).type == pafs.FileType.Directory:
        files.delete_dir(at)
    return total + len(tail)


def _copied(files: pafs.FileSystem, source: str, path: str, start: int, end: int) -> int:
    with files.open_input_file(source) as file, files.open_output_stream(path, compression=None) as out:
        file.seek(start)
        left = end - start
        while left and (chunk := file.read(min(left, bgzf.STEP))):
            out.write(chunk)
            left -= len(chunk)
    return end - start


def _merged(files: pafs.FileSystem, source: str, path: str, unit: dict, level: int) -> int:
    tests = [("GreaterThanOrEqual", "pos", unit["least"]), ("LessThan", "pos", unit["after"])] if unit["after"] != LAST else [("GreaterThanOrEqual", "pos", unit["least"])]
    own = _records(f"{source}/{unit['bucket']}.gz", tests)
    apart = _records(f"{source}/{DISCORDANT}.gz", [*tests, ("EqualTo", "rname", unit["bucket"])])
    part = bgzf.Part(files, path, level)
    for batch in merged_batches(own, apart):
        part.add(pa.RecordBatch.from_arrays([batch["line"], batch["pos"], pa.array(np.zeros(batch.num_rows, bool))], ["text", "at", "is_dup"]))
    part.close()
    return int(sum(part.sizes))
