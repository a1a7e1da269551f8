"""Removal of repeated byte strings, by suffix sorting of the places that can hold them.

Every ``width`` bytes of a document that also start anywhere else are removed.
``segments`` finds where: windows of equal key and content are repetitions,
windows whose key stands once are none.  Segments whose key has several
contents are dealt into shards by key, and each shard's suffixes are sorted by
induction with their common prefixes (``induced``): two neighbours that share
``width`` bytes are repetitions.  A key with more than ``KEY_BYTES`` of segments
is split first by more keys, the least grams under ``LEVELS`` further orders,
so that a frequent passage in many surroundings falls apart into small groups.
What still shares all of them is sorted as one shard, in files where it is
larger than ``HELD_BYTES``.

Texts are UTF-8 bytes and may be cut inside a character.  Nulls: a null text is
empty.  Rows equal in id and text are one document and get the same result; a
null id is an id of its own.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import induced, shared
from . import segments as sg
from . import textvec as tv
from .warc import opened

U64 = np.uint64
#: Bytes of a gram whose least hash is a window's key.
GRAM = 64
#: Further orders of each level.
LEVELS = (8, 8, 8)
#: Bytes of segments of one key that are not split further.
KEY_BYTES = 4 << 20
#: Bytes of segments in a shard, about.
SHARD_BYTES = 2 << 20
#: Bytes of a shard that are sorted in memory, at some 100 bytes each; a larger one is sorted in files.
HELD_BYTES = 8 << 20


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of each GRAM consecutive bytes, by doubling."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, U64)
    own, size = data.astype(U64), 1
    while size < GRAM:
        if size < 8:
            own = own[:-size] | own[size:] << U64(8 * size)
        else:
            own = tv.mix(own[:-size] * U64(0x9E3779B97F4A7C15) + own[size:])
        size *= 2
    return own


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """A row for each segment of the texts (doc, sub, __text), combined in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sg.Combiner()
        for batch in batches:
            doc, sub = batch["doc"].to_numpy(), batch["sub"].to_numpy()
            for low, high in tv.slices(batch["__text"]):
                data, first = tv.buffers(batch["__text"].slice(low, high - low))
                key, start, count = sg.segment_bounds(data, _grams(data), first, GRAM, width)
                own = np.searchsorted(first, start, "right") - 1
                content = tv.digests(memoryview(data), start, start + count - 1 + width)
                yield from rows.add(key=key, content=content, doc=doc[low + own], sub=sub[low + own], start=(start - first[own]).astype(np.int32), count=count.astype(np.int32))
        yield from rows.flush()

    return docs.select("doc", "sub", "__text").mapInArrow(run, sg.ROWS)


def _split(docs: DataFrame, width: int, orders: int, level: int) -> DataFrame:
    """Rows for the parts into which further keys split the segments ``spans`` of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sg.Combiner()
        for batch in batches:
            for text, doc, sub, spans in zip(batch["__text"], batch["doc"].to_pylist(), batch["sub"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                grams = _grams(data)
                # Segments of the last level that a position order brings together again must stay apart.
                spans = sorted((s["start"], s["count"], s["key"]) for s in spans)
                window = np.concatenate([np.arange(s, s + n) for s, n, _ in spans])
                key = np.concatenate([np.full(n, k, np.int64) for _, n, k in spans]).view(U64)
                new = np.zeros(len(window), bool)
                new[np.cumsum([0, *(n for _, n, _ in spans[:-1])])] = True
                for i in range(orders):
                    salted = tv.mix(grams ^ U64((level * 1000 + i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
                    at = tv.sliding_argmin(salted, width - GRAM + 1)[window]
                    new[1:] |= at[1:] != at[:-1]
                    key = tv.mix(key * U64(3) + salted[at])
                first = np.flatnonzero(new)
                start, count = window[first], np.diff(np.append(first, len(window)))
                m = len(first)
                yield from rows.add(key=key[first], content=tv.digests(memoryview(data), start, start + count - 1 + width), doc=np.full(m, doc, np.int64), sub=np.full(m, sub, np.int32), start=start.astype(np.int32), count=count.astype(np.int32))
        yield from rows.flush()

    return docs.select("doc", "sub", "__text", "spans").mapInArrow(run, sg.ROWS)


def _spans(segments: DataFrame) -> DataFrame:
    """(doc, sub, spans) of marked segments."""
    return segments.groupBy("doc", "sub").agg(F.collect_list(F.struct("start", "count", "key")).alias("spans"))


def _scratch(folder: str) -> induced.Files:
    """Files of one task below a folder of the shared store."""
    where, at = opened(f"{folder}/{uuid.uuid4().hex}")
    made: list[bool] = []

    def write(name: str, data: bytes) -> None:
        if not made:
            where.create_dir(at, recursive=True)
            made.append(True)
        with where.open_output_stream(f"{at}/{name}") as file:
            file.write(data)

    def read(name: str) -> bytes:
        with where.open_input_stream(f"{at}/{name}") as file:
            return file.read()

    return induced.Files(write, read, lambda name: where.delete_file(f"{at}/{name}"))


def repeated_windows(pieces: list[bytes], width: int, files: induced.Files, held: int = induced.HELD) -> list[np.ndarray]:
    """For each piece the starts of windows that stand more than once in the pieces."""
    text = b"".join(pieces)
    size = np.array([len(p) for p in pieces], np.int64)
    ends = np.cumsum(size)
    if len(text) <= HELD_BYTES:
        blocks = [induced.sort_held(np.frombuffer(text, np.uint8), width)]
    else:
        blocks = _in_arrays(induced.sort(text, files, most=width, held=held))
    hit, last, low = np.zeros(len(text), bool), -1, 0
    for position, prefix in blocks:
        # Suffixes with less than a window left in their piece are passed over; the common prefix to the next is the least between.
        keep = np.flatnonzero(ends[np.searchsorted(ends, position, "right")] - position >= width)
        rest = int(prefix.min()) if len(prefix) else width
        if not len(keep):
            low = min(low, rest)
            continue
        share = np.minimum.reduceat(prefix[: keep[-1] + 1], np.append(0, keep[:-1] + 1))
        share[0] = min(share[0], low) if last >= 0 else 0
        own = position[keep]
        same = np.flatnonzero(share >= width)
        hit[own[same]] = True
        hit[np.append(last, own[:-1])[same]] = True
        last = int(own[-1])
        low = int(prefix[keep[-1] + 1 :].min(initial=width))
    starts = np.flatnonzero(hit)
    return [x - a for x, a in zip(np.split(starts, np.searchsorted(starts, ends[:-1])), ends - size, strict=True)] if len(pieces) else []


def _in_arrays(entries: Iterator[tuple[int, int]], most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    while some := list(itertools.islice(entries, most)):
        own = np.array(some, np.int64)
        yield own[:, 0], own[:, 1]


def _sorted_shards(docs: DataFrame, width: int, folder: str, shards: int) -> DataFrame:
    """(doc, sub, start, count) of repeated windows in the segments ``spans`` of documents, by suffix arrays of shards."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, doc, sub, spans in zip(batch["__text"], batch["doc"].to_pylist(), batch["sub"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                keys, starts = [s["key"] for s in spans], [s["start"] for s in spans]
                own = [raw[s["start"] : s["start"] + s["count"] - 1 + width] for s in spans]
                m = len(spans)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([doc] * m, pa.int64()), pa.array([sub] * m, pa.int32()), pa.array(starts, pa.int32()), pa.array(own, pa.binary())], ["key", "doc", "sub", "start", "piece"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ended() -> Iterator[pa.RecordBatch]:
            files = _scratch(folder)
            try:
                found = repeated_windows([p for _, p in held], width, files)
            finally:
                files.close()
            rows = []
            for ((doc, sub, start), _), hit in zip(held, found, strict=True):
                if len(hit):
                    cut = np.flatnonzero(np.diff(hit) != 1) + 1
                    rows.extend((doc, sub, start + int(x[0]), len(x)) for x in np.split(hit, cut))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["doc", "sub", "start", "count"])

        held, size, last, whole = [], 0, None, None
        for batch in batches:
            for key, doc, sub, start, piece in zip(*(batch[c].to_pylist() for c in ("key", "doc", "sub", "start", "piece")), strict=True):
                if key != last and size >= SHARD_BYTES:
                    yield from ended()
                    held, size = [], 0
                if (key, doc, sub, start) != whole:
                    held.append(((doc, sub, start), piece))
                    size += len(piece)
                last, whole = key, (key, doc, sub, start)
        if held:
            yield from ended()

    made = docs.select("doc", "sub", "__text", "spans").mapInArrow(pieces, "key long, doc long, sub int, start int, piece binary")
    return made.repartition(shards, "key").sortWithinPartitions("key", "doc", "sub", "start").mapInArrow(run, "doc long, sub int, start int, count int")


def repetitions(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 200) -> DataFrame:
    """(doc, sub, spans): for each document with repetitions the windows that are one."""
    if width < 2 * GRAM:
        raise ValueError(f"width must be {2 * GRAM} at least")
    spark = shared.session(docs)
    texts = sg.keyed(docs, id_col, text_col).select("doc", "sub", "__text")
    columns = ("doc", "sub", "start", "count")
    rows, level = fingerprints(texts, width), 0
    open_, removed, tables = [], [], []
    while True:
        found = shared.written(sg.exchanged(rows).mapInArrow(sg.marks(True), sg.MARKS), "marks")
        tables.append(found)
        shared.released(spark)
        removed.append(found.where(F.col("tag") == sg.REMOVE).select(*columns))
        left = found.where(F.col("tag") != sg.REMOVE)
        large = left.groupBy("key").agg(F.sum(F.col("count").cast("long") + width - 1).alias("bytes")).where(F.col("bytes") > KEY_BYTES).select("key")
        if level == len(LEVELS) or large.isEmpty():
            open_.append(left)
            break
        open_.append(left.join(large, "key", "left_anti"))
        hot = shared.written(left.join(large, "key", "left_semi"), "hot")
        rows = _split(shared.only(texts, hot, "doc").join(_spans(hot), ["doc", "sub"]), width, LEVELS[level], level)
        tables.append(hot)
        level += 1
    left = functools.reduce(DataFrame.unionByName, open_)
    size = int(left.select(F.sum(F.col("count").cast("long") + width - 1)).first()[0] or 0)
    shards = max(1, -(-size // SHARD_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")) if size > SHARD_BYTES else 1)
    folder = shared.fresh_path(spark, "suffixes")
    removed.append(_sorted_shards(texts.join(_spans(left), ["doc", "sub"]), width, folder, shards))
    spans = shared.written(sg.windows_of(functools.reduce(DataFrame.unionByName, removed)), "spans")
    for table in tables:
        shared.dropped(table)
    shared.released(spark)
    return spans


def strip(docs: DataFrame, spans: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 200) -> DataFrame:
    """docs as (__id, __kept, __rest, n_bytes, n_removed, n_spans): the remaining bytes and what went."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, counts = [], []
            for text, own in zip(batch["__text"], batch["spans"].to_pylist(), strict=True):
                raw = text.as_buffer()
                raw = b"" if raw is None else raw.to_pybytes()
                gone = sg.covered(own, width, len(raw))
                if gone is None:
                    kept.append(raw)
                    counts.append((len(raw), 0, 0))
                    continue
                data = np.frombuffer(raw, np.uint8)
                kept.append(data[~gone].tobytes())
                counts.append((len(raw), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())))
            numbers = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)] if counts else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch["__id"], pa.array(kept, pa.binary()), batch["__rest"], *numbers], ["__id", "__kept", "__rest", "n_bytes", "n_removed", "n_spans"])

    joined = sg.with_spans(sg.keyed(docs, id_col, text_col, True), spans).drop("doc", "sub")
    kinds = dict(joined.dtypes)
    return joined.mapInArrow(run, f"__id {kinds['__id']}, __kept binary, __rest {kinds['__rest']}, n_bytes long, n_removed long, n_spans long")



def op10_suffix_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The digest of the removal over all documents."""
    narrow = docs.select("doc_id", "text")
    out = strip(narrow, repetitions(narrow))
    return out.select(F.col("__id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("__kept", 256).alias("kept_sha256"))
