"""Packing of tokenised documents into sequences, shortest pack first over the length histogram.

Documents are tokenised, ended by an end id and cut into pieces of at most
``size`` ids.  Only the histogram of piece lengths (``size`` numbers, whatever
the corpus) reaches the driver: lengths are placed longest first, each time
into the packs with the most room left, and packs with the same contents are
one pattern with a count.  A pattern's slots are then ranges of ranks among the
pieces of one length, so that each piece finds its sequence and offset from its
own rank, without any group of pieces in one task.

Nulls: a null or empty text is the end id alone; a null id is kept.  Repeated
rows are packed each.  A table without rows gives none.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

#: Fixed value: the pattern by which byte-level BPE of this vocabulary splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@cache
def encoder(path: str):
    """A function from text to ids for a byte-level BPE file, with the ids that the tokenizers library gives.

    The merges run in tiktoken over the ranks in the same file, four times as
    fast with equal ids (tests compare them); a text on which it fails goes to
    the tokenizers library itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    byte_of = _byte_of()
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    slow: list[Tokenizer] = []

    def encode(text: str) -> np.ndarray:
        try:
            return np.array(fast.encode(text, allowed_special="all"), np.uint32)
        except Exception:  # the regular expression's own limits, on odd texts
            if not slow:
                slow.append(Tokenizer.from_file(path))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def token_pieces(docs: DataFrame, tokenizer: str, *, id_col: str, text_col: str, size: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """(part, rank, doc_id, start, length, ids_crc32, doc_tokens[, ids]): the pieces; rank counts pieces of the same length in the same part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), {}
        for batch in batches:
            rows = []
            for doc, text in zip(batch[0].to_pylist(), batch[1], strict=True):
                text = text.as_py()
                ids = np.append(encode(text) if text else np.zeros(0, np.uint32), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), size):
                    own = ids[start : start + size]
                    rank = seen[len(own)] = seen.get(len(own), -1) + 1
                    rows.append((part, rank, doc, start, len(own), zlib.crc32(own.tobytes()), len(ids), *([own.astype(np.int32)] if with_ids else [])))
            columns = list(zip(*rows, strict=True)) or [[]] * (7 + with_ids)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names)

    schema = "part int, rank long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).mapInArrow(run, schema)


def pack_histogram(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in one sequence, in order) and how many sequences follow each."""
    by_room: dict[int, list[list]] = {}  # room left: entries [pattern, count]
    rooms: list[int] = []

    def add(room: int, pattern: tuple[int, ...], count: int) -> None:
        if room not in by_room:
            insort(rooms, room)
            by_room[room] = []
        by_room[room].append([pattern, count])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not rooms or rooms[-1] < length:
                add(size - length, (length,), left)
                break
            room = rooms[-1]
            pattern, count = by_room[room].pop()
            n = min(left, count)
            if count > n:
                by_room[room].append([pattern, count - n])
            elif not by_room[room]:
                del by_room[room]
                rooms.pop(bisect_right(rooms, room) - 1)
            add(room - length, (*pattern, length), n)
            left -= n
    return [(p, n) for room in rooms for p, n in by_room[room]]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length: rows (first rank, first sequence, offset); the ranks from one row to the next go to consecutive sequences."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    given: dict[int, int] = {}
    sequence = 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            out.setdefault(length, []).append((given.get(length, 0), sequence, offset))
            given[length] = given.get(length, 0) + count
            offset += length
        sequence += count
    return {length: np.array(rows, np.int64) for length, rows in out.items()}


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with sequence_id and offset; with_ids adds each piece's ids."""
    spark = shared.session(docs)
    made = shared.written(token_pieces(docs, tokenizer, id_col=id_col, text_col=text_col, size=size, end_id=end_id, with_ids=with_ids), "pieces")
    by_part = shared.checkpointed(made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    # At most `size` rows, whatever the corpus.
    histogram = {int(r["length"]): int(r["n"]) for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(slots(pack_histogram(histogram, size)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = made.join(base, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base")).drop("part", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for one in np.unique(length):
                at, own = np.flatnonzero(length == one), places.value[int(one)]
                row = own[np.searchsorted(own[:, 0], rank[at], "right") - 1]
                sequence[at], offset[at] = row[:, 1] + rank[at] - row[:, 0], row[:, 2]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    kept = [c for c in ranked.columns if c not in ("length", "rank")] + ["length"]
    kinds = dict(ranked.dtypes)
    return ranked.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_packing(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The pieces of all documents in sequences of 2048 ids."""
    return pack(docs, default_tokenizer()).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
