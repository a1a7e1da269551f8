"""SAM text as a Spark data source: ``spark.dataSource.register(SamDataSource)``, then ``spark.read.format("sam")``.

Byte ranges of the files are the partitions, of block-gzipped files too; a task
owns the lines that start in its range and ``line_no`` is a line's byte offset
(of its block and in it, if blocked), so order and identity don't depend on the
number of partitions.  The files of a folder are read in the order of their
names, and a file's numbers start where those of the files before it end.

A schema of fewer columns makes a scan cut only these.  Option ``split_bytes``
sets the range, ``min_mapq`` drops records of lower quality whose mate lies on
the same reference, if the header names it.  With ``push`` (and the session's
spark.sql.python.filterPushdown.enabled) comparisons of columns with values are
made by the scan and leave the plan.  Header lines are skipped; empty files and
those whose names begin with a dot or an underscore give no rows.

Files written with an index (see ``bgzf``) are opened only at blocks whose
positions fit a pushed comparison of ``pos``.  Option ``check_end`` raises an
error where a block-gzipped file lacks the block that marks its end; a block
that is cut off always does.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition

from ..schema import RAW
from . import blocks, columns

TYPES = dict(c.split() for c in RAW.split(", "))


def located(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if re.match(r"\w+:/", path) else f"file://{path}")


def files(path: str) -> list[pafs.FileInfo]:
    """The file, or the files of a folder in the order of their names."""
    where, at = located(path)
    info = where.get_file_info(at)
    if info.type != pafs.FileType.Directory:
        return [info]
    inside = where.get_file_info(pafs.FileSelector(at))
    return sorted((f for f in inside if f.type == pafs.FileType.File and f.base_name[0] not in "._"), key=lambda f: f.base_name)


def _header(where: pafs.FileSystem, at: str) -> list[str]:
    """The lines of a file before its first record."""
    out, rest = [], b""
    with where.open_input_file(at) as file:
        if blocks.is_blocked(file):
            found = itertools.takewhile(lambda x: x.startswith(b"@"), (line for _, line in blocks.lines(file, 0, file.size())))
            return [x.decode().rstrip("\r") for x in found]
        file.seek(0)
        while chunk := file.read(1 << 16):
            *lines, rest = (rest + chunk).split(b"\n")
            for line in lines:
                if not line.startswith(b"@"):
                    return out
                out.append(line.decode().rstrip("\r"))
    return out + ([rest.decode()] if rest.startswith(b"@") else [])


def header(path: str) -> list[str]:
    """The lines before the first record; of a folder those of all files, each once, with the first @HD.

    Files that give one reference different lengths don't belong together and raise an error.
    """
    where, _ = located(path)
    found = list(dict.fromkeys(line for f in files(path) for line in _header(where, f.path)))
    heads = [x for x in found if x.startswith("@HD")]
    out = [x for x in found if not x.startswith("@HD") or x == heads[0]]
    seen = {}
    for line in out:
        if line.startswith("@SQ\t"):
            name, length = (next((f[3:] for f in line.split("\t") if f.startswith(k)), None) for k in ("SN:", "LN:"))
            if seen.setdefault(name, length) != length:
                raise ValueError(f"reference {name} has the lengths {seen[name]} and {length}")
    return out


def _field(lines: list[str], kind: str, name: str) -> list[str]:
    found = (f[len(name) + 1 :] for x in lines if x.startswith(kind + "\t") for f in x.split("\t")[1:] if f.startswith(name + ":"))
    return list(dict.fromkeys(found))


def references(lines: list[str]) -> list[str]:
    """Names of @SQ lines, in order, each once."""
    return _field(lines, "@SQ", "SN")


def libraries(lines: list[str]) -> list[str]:
    """Names of the @RG lines' libraries, then the two that stand for none."""
    return [*_field(lines, "@RG", "LB"), "unknown", "unmapped"]


def sorted_header(lines: list[str], order: str = "coordinate", *, verbatim: bool = False) -> list[str]:
    """The header of an output, with its sort order; verbatim keeps an @HD line that is there as a second one."""
    rest = lines if verbatim else [x for x in lines if not x.startswith("@HD")]
    return [f"@HD\tVN:1.0\tSO:{order}", *rest]


def _checked(where: pafs.FileSystem, at: str) -> None:
    with where.open_input_file(at) as file:
        if blocks.is_blocked(file) and not blocks.ended(file):
            raise EOFError(f"{at} lacks the block that marks its end")


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, base: int = 0, known: Iterable[str] = (), skip: int | None = None):
        self.path, self.start, self.end, self.base, self.known, self.skip = path, start, end, base, tuple(known), skip


class SamReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.path, self.split = options["path"], int(options.get("split_bytes", 64 << 20))
        self.min_mapq = int(options.get("min_mapq", 0))
        self.check_end = str(options.get("check_end", "false")).lower() == "true"
        self.names, self.tests = names, []

    def partitions(self) -> list[Range]:
        prefix, where = re.match(r"\w+://[^/]*", self.path), located(self.path)[0]
        known = references(header(self.path)) if self.min_mapq > 0 else ()
        out, base = [], 0
        for f in files(self.path):
            name = (prefix[0] if prefix else "") + f.path
            if self.check_end:
                _checked(where, f.path)
            runs = self._indexed(f)
            if runs is None:
                runs = [(s, min(s + self.split, f.size), None) for s in range(0, f.size, self.split)]
            out += [Range(name, start, end, base, known, skip) for start, end, skip in runs]
            base += f.size << 16  # no less than the numbers of a file, blocked or not
        return out or [Range("", 0, 0)]

    def _indexed(self, f: pafs.FileInfo) -> list[tuple[int, int, int]] | None:
        """Runs of blocks (start, end, bytes before the first line) that may hold the positions asked for; None without an index or such a filter."""
        bounds = {"GreaterThan": "last_pos", "GreaterThanOrEqual": "last_pos", "LessThan": "first_pos", "LessThanOrEqual": "first_pos"}
        asked = [(kind, v) for kind, column, v in self.tests if column == "pos" and (kind in bounds or kind == "EqualTo")]
        folder, name = f.path.rsplit("/", 1)
        where, _ = located(self.path)
        index = f"{folder}/.index/{name.removesuffix('.gz')}"
        if not asked or where.get_file_info(index).type != pafs.FileType.Directory:
            return None
        keep = pc.scalar(True)
        for kind, v in asked:
            kinds = ("GreaterThanOrEqual", "LessThanOrEqual") if kind == "EqualTo" else (kind,)
            for k in kinds:
                keep = keep & columns.TESTS[k](pc.field(bounds[k]), v)
        rows = pq.read_table(index, filesystem=where, columns=["place", "end", "first_line"], filters=keep).sort_by("place")
        out = []
        for place, end, first in zip(*(rows[c].to_pylist() for c in ("place", "end", "first_line")), strict=True):
            if out and out[-1][1] == place and end - out[-1][0] <= self.split:
                out[-1] = (out[-1][0], end, out[-1][2])
            else:
                out.append((place, end, first))
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.end <= partition.start:
            return
        where, at = located(partition.path)
        with where.open_input_file(at) as file:
            more = {} if partition.skip is None else {"skip": partition.skip}
            read = blocks.texts if blocks.is_blocked(file) else texts
            for data, pieces, bases in read(file, partition.start, partition.end, **more):
                chunk = columns.Chunk(data, pieces, bases + partition.base)
                columns.passed(chunk, self.tests)
                if self.min_mapq > 0:
                    self._good(chunk, partition.known)
                if len(chunk.starts):
                    yield chunk.batch(self.names)

    def _good(self, chunk: columns.Chunk, known: tuple[str, ...]) -> None:
        """Leave out records of low quality whose mate lies on the same, known reference."""
        low = np.flatnonzero(chunk.column("mapq").to_numpy() < self.min_mapq)
        own, mate = (chunk.column(c).take(pa.array(low)) for c in ("rname", "rnext"))
        same = pc.or_(pc.equal(mate, "="), pc.equal(mate, own))
        keep = np.ones(len(chunk.starts), bool)
        keep[low] = ~pc.and_(same, pc.is_in(own, pa.array(known, pa.string()))).to_numpy(zero_copy_only=False).astype(bool)
        chunk.where(keep)


class PushingReader(SamReader):
    """A reader that takes comparisons with values from the plan."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            kind, column, value = type(f).__name__, getattr(f, "attribute", ()), getattr(f, "value", None)
            if not columns.handled(kind, column, value):
                yield f
            elif kind != "IsNotNull":
                self.tests.append((kind, column[0], value))


def texts(file, start: int, end: int, step: int = 4 << 20) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Whole lines of a range of a plain file, with the place of their numbers (see columns.Chunk).

    A range that does not begin with a line leaves the broken one to the range before.
    """
    at = max(start - 1, 0)
    file.seek(at)
    held, skipping = b"", start > 0
    while True:
        more = file.read(step)
        held += more
        if skipping:
            cut = held.find(b"\n") + 1
            if not cut:
                if not more:
                    return
                at, held = at + len(held), b""
                continue
            at, held, skipping = at + cut, held[cut:], False
        if at >= end:
            return
        last = at + len(held) >= end
        cut = (held.find(b"\n", max(end - 1 - at, 0)) if last else held.rfind(b"\n")) + 1
        if not more:
            cut = cut or len(held)
        if cut:
            yield held[:cut], np.zeros(1, np.int64), np.array([at])
            at, held = at + cut, held[cut:]
            if last:
                return
        if not more:
            return


class SamDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sam"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> SamReader:
        kind = PushingReader if str(self.options.get("push", "false")).lower() == "true" else SamReader
        return kind(self.options, schema.fieldNames())


def read_sam(spark: SparkSession, path: str, *, only: Iterable[str] | None = None, push: bool = True, **options) -> DataFrame:
    """The records of a file or folder, of ``only`` some columns if named; push lets the scan apply filters, and sets the session so."""
    spark.dataSource.register(SamDataSource)
    if push:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("sam").options(**{k: str(v) for k, v in options.items()}, push=str(push).lower())
    if only is not None:
        reader = reader.schema(", ".join(f"{c} {TYPES[c]}" for c in only))
    return reader.load(path)
