"""Content-defined segments of windows: the exchange behind both substring operators.

A window is W consecutive symbols of one text.  Every window is assigned the
least hash of the k-symbol grams inside it, its key; consecutive windows with
the same key at the same place (the leftmost) make a segment, so no two windows
of one segment are equal, however periodic the text.  Equal windows have equal keys wherever they
stand, so only segments with the same key can share a window, and segments
with the same key and the same content (64 bits of a cryptographic digest of
its symbols, so that no form of text makes two contents agree) share all of
theirs.  That leaves

1. one row a segment to be exchanged, not one a window;
2. of equal segments, all but the first decided at once.  Each task combines
   its own rows first, so that a passage in a third of all documents sends a
   row a task, not a row a document;
3. of the others, only first segments whose key has another content to be
   compared window by window, or by suffixes.

Positions are (doc, sub, start): ``doc`` the id with null as the least long,
``sub`` a hash of the text, ``start`` the symbol.  Rows equal in id and text
are one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from . import textvec as tv

U64 = np.uint64
NO_ID = -(1 << 63)
#: Rows of one task that are combined before they go to the exchange.
COMBINE = 500_000
FIELDS = ("kind", "route", "key", "content", "age", "doc", "sub", "start", "count", "n")
ROWS = "kind byte, route long, key long, content long, age byte, doc long, sub int, start int, count int, n int"
KINDS = dict(zip(FIELDS, (pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int8(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()), strict=True))
#: kind of a row: the first of its content, as far as its task knows, or known to be a repetition.
FIRST, REPEATED = 0, 1


def keyed(docs: DataFrame, id_col: str, text_col: str, others: bool = False) -> DataFrame:
    """docs as (doc, sub, __id, __text, __rest)."""
    wide = shared.packed(docs, id_col, text_col, others)
    return wide.select(F.coalesce(F.col("__id").cast("long"), F.lit(NO_ID)).alias("doc"), F.hash("__text").alias("sub"), "__id", "__text", "__rest")


def segment_bounds(symbols: np.ndarray, grams: np.ndarray, first: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, first window and number of windows of all segments; first: the first symbol of each text."""
    window = tv.windows_inside(first, width)
    if not len(window):
        return np.zeros(0, U64), window, window
    at = tv.sliding_argmin(grams, width - k + 1)[window]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)])
    return grams[at[new]], window[new], np.diff(np.append(new, len(window)))


def _same(c: dict[str, np.ndarray], group: np.ndarray) -> np.ndarray:
    """Which sorted rows repeat the position before them; group: which begin another content."""
    return np.r_[False, ~group[1:] & np.logical_and.reduce([c[f][1:] == c[f][:-1] for f in ("age", "doc", "sub", "start")])]


class Combiner:
    """Rows of one task, combined whenever COMBINE of them are held."""

    def __init__(self):
        self.held: list[dict[str, np.ndarray]] = []
        self.size = 0

    def add(self, **rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(rows)
        self.size += len(rows["key"])
        if self.size >= COMBINE:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        c = {f: np.concatenate([x[f] for x in self.held]) for f in self.held[0]}
        self.held, self.size = [], 0
        c.setdefault("age", np.ones(len(c["key"]), np.int8))
        order = np.lexsort((c["start"], c["sub"], c["doc"], c["age"], c["content"], c["key"]))
        c = {f: x[order] for f, x in c.items()}
        group = np.r_[True, (c["key"][1:] != c["key"][:-1]) | (c["content"][1:] != c["content"][:-1])]
        same = _same(c, group)
        at = np.flatnonzero(group)
        n = np.zeros(len(group), np.int32)
        n[at] = np.add.reduceat((~same).astype(np.int32), at)
        keep = ~same
        c = {f: x[keep] for f, x in c.items()} | {"n": n[keep]}
        kind = np.where(group[keep], FIRST, REPEATED).astype(np.int8)
        # Repetitions need no meeting: they go anywhere.
        route = np.where(kind == FIRST, c["key"], tv.mix(c["key"] + c["start"].astype(U64) * U64(0x9E3779B97F4A7C15) + c["doc"].view(U64)))
        made = {"kind": kind, "route": route.view(np.int64)} | c | {"key": c["key"].view(np.int64), "content": c["content"].view(np.int64)}
        for a in range(0, len(kind), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(made[f][a : a + 50_000], KINDS[f]) for f in FIELDS], list(FIELDS))


def exchanged(rows: DataFrame) -> DataFrame:
    """The rows of one key in one partition, sorted; needs no memory for a group. Firsts only, repetitions spread evenly."""
    return rows.repartition("route").sortWithinPartitions("kind", "key", "content", "age", "doc", "sub", "start")


#: tag of a mark: windows that are repetitions; a first segment whose key has further contents; the same, known to be repeated.
REMOVE, COMPARE, WITNESS = 0, 1, 2
MARKS = "tag byte, key long, age byte, doc long, sub int, start int, count int"


def marks(everyone: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over sorted rows that gives marks; everyone: the first of several equal segments is to be removed too.

    Only the last group of a batch is held back, as one row, so memory doesn't
    grow with a group.
    """

    def out(tag: int, c: dict[str, np.ndarray], at: np.ndarray) -> pa.RecordBatch:
        own = [np.full(len(at), tag, np.int8), *[c[f][at] for f in ("key", "age", "doc", "sub", "start", "count")]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in own], [x.split()[0] for x in MARKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: dict[str, np.ndarray] | None = None
        carry_many = False
        for batch in batches:
            c = {f: batch[f].to_numpy(zero_copy_only=False) for f in FIELDS if f != "route"}
            known = c["kind"] == REPEATED
            if known.any():
                yield out(REMOVE, c, np.flatnonzero(known))
                c = {f: x[~known] for f, x in c.items()}
            if not len(c["key"]):
                continue
            if carry is not None:
                c = {f: np.concatenate((carry[f], x)) for f, x in c.items()}
            group = np.r_[True, (c["key"][1:] != c["key"][:-1]) | (c["content"][1:] != c["content"][:-1])]
            same = _same(c, group)
            at = np.flatnonzero(group)
            later = np.flatnonzero(~group & ~same & (c["age"] == 1))
            if len(later):
                yield out(REMOVE, c, later)
            n = np.maximum(np.add.reduceat(np.where(same, 0, c["n"]), at), 1)
            key = c["key"][at]
            new_key = np.r_[True, key[1:] != key[:-1]]
            key_no = np.cumsum(new_key) - 1
            many = (np.bincount(key_no)[key_no] >= 2) | (carry_many & (key_no == 0))
            yield from done(c, at[:-1], n[:-1], many[:-1])
            carry = {f: x[at[-1:]] for f, x in c.items()} | {"n": n[-1:].astype(np.int32)}
            carry_many = bool(many[-1])
        if carry is not None:
            yield from done(carry, np.zeros(1, np.int64), carry["n"], np.array([carry_many]))

    def done(c: dict[str, np.ndarray], at: np.ndarray, n: np.ndarray, many: np.ndarray) -> Iterator[pa.RecordBatch]:
        repeated = (n >= 2) & (everyone & (c["age"][at] == 1))
        if repeated.any():
            yield out(REMOVE, c, at[repeated])
        if (many & ~repeated).any():
            yield out(COMPARE, c, at[many & ~repeated])
        if (many & repeated).any():
            yield out(WITNESS, c, at[many & repeated])

    return run


def windows_of(marked: DataFrame) -> DataFrame:
    """(doc, sub, spans): for each document the windows to remove; at most as many entries as the document has segments."""
    return marked.groupBy("doc", "sub").agg(F.collect_list(F.struct("start", "count")).alias("spans"))


def covered(spans: list[dict] | None, width: int, n: int) -> np.ndarray | None:
    """Which of n symbols are covered by the windows in spans; None: none."""
    if not spans:
        return None
    edge = np.zeros(n + 1, np.int64)
    start = np.array([s["start"] for s in spans], np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + np.array([s["count"] for s in spans], np.int64) - 1 + width, -1)
    return np.cumsum(edge[:-1]) > 0


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Documents with what was found for them, null where nothing was."""
    return docs.join(spans, ["doc", "sub"], "left")
