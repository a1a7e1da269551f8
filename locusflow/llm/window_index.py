"""Incremental removal of repeated word windows, over a log-structured fingerprint index.

Each batch of documents adds one immutable run to the index: the fingerprints
(key, content, position) of its segments of 20-word windows (see ``segments``),
sorted by key.  A new batch is sorted the same way and merged with the runs; a
window that stood in an earlier batch, or earlier in its own (smaller id, or
the same document further on), is a repetition.  Where two segments share a key
but not all their windows, the windows themselves are compared, from the texts
again.  Contents are verified: keys are hashes, but segments and windows count
as equal only if a cryptographic digest of their words' bytes agrees too.
``compact`` merges runs and keeps the first occurrence of each content.

Words are runs of bytes other than space and TAB..CR, unchanged.  Nulls: a null
text has no words; rows with a null id come before all others.  Rows equal in id
and text are one document and get the same result; rows equal in id alone are
ordered by a hash of their text.  A document that an earlier batch held already
is a repetition as a whole.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import segments as sg
from . import shared
from . import textvec as tv

U64 = np.uint64
#: Words of a gram whose least hash is a window's key.
GRAM = 5


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, memoryview, np.ndarray]:
    """Hashes of all words, the first word of each text, and the words' bytes, a space after each, with the start of each (and the end)."""
    data, offsets = tv.buffers(column)
    starts, ends, first = tv.word_bounds(data, offsets)
    length = ends - starts
    at = np.concatenate(([0], np.cumsum(length + 1)))
    plain = np.full(int(at[-1]), 0x20, np.uint8)
    source = np.repeat(starts - at[:-1], length + 1) + np.arange(len(plain))
    inside = np.ones(len(plain), bool)
    inside[at[1:] - 1] = False
    plain[inside] = data[source[inside]]
    return tv.word_hashes(data, starts, ends, False), first, memoryview(plain), at


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """A row for each segment of the texts (doc, sub, __text), combined in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sg.Combiner()
        for batch in batches:
            doc, sub = batch["doc"].to_numpy(), batch["sub"].to_numpy()
            for low, high in tv.slices(batch["__text"]):
                h, first, plain, at = _words(batch["__text"].slice(low, high - low))
                key, start, count = sg.segment_bounds(h, tv.grams(h, GRAM), first, GRAM, width)
                own = np.searchsorted(first, start, "right") - 1
                content = tv.digests(plain, at[start], at[start + count - 1 + width])
                yield from rows.add(key=key, content=content, doc=doc[low + own], sub=sub[low + own], start=(start - first[own]).astype(np.int32), count=count.astype(np.int32))
        yield from rows.flush()

    return docs.select("doc", "sub", "__text").mapInArrow(run, sg.ROWS)


def _window_rows(docs: DataFrame, width: int) -> DataFrame:
    """A row for each window in the segments to be compared: documents with ``spans`` (start, count, age)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sg.Combiner()
        for batch in batches:
            docs_, subs, spans = batch["doc"].to_numpy(), batch["sub"].to_numpy(), batch["spans"]
            for low, high in tv.slices(batch["__text"]):
                h, first, plain, at = _words(batch["__text"].slice(low, high - low))
                own = spans.slice(low, high - low)
                flat = own.flatten()
                begin, n, age = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("start", "count", "age"))
                text = np.repeat(np.repeat(np.arange(high - low), pc.list_value_length(own).to_numpy()), n)
                start = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                here = start + first[text]
                end = at[here + width]
                yield from rows.add(key=tv.range_hashes(h, here, here + width), content=tv.digests(plain, at[here], end), age=np.repeat(age, n).astype(np.int8), doc=docs_[low + text], sub=subs[low + text], start=start.astype(np.int32), count=np.ones(len(here), np.int32))
        yield from rows.flush()

    return docs.select("doc", "sub", "__text", "spans").mapInArrow(run, sg.ROWS)


class WindowIndex:
    """Runs of fingerprints in the shared folder, with the texts of the batches they came from."""

    def __init__(self, spark: SparkSession, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", width: int = 20):
        self.spark, self.path = spark, path or shared.fresh_path(spark, "windows")
        self.id_col, self.text_col, self.width = id_col, text_col, width
        self.runs: list[str] = []
        self.batches: list[DataFrame] = []

    def _history(self) -> DataFrame | None:
        if not self.runs:
            return None
        return self.spark.read.parquet(*self.runs).withColumn("age", F.lit(0).cast("byte"))

    def repetitions(self, docs: DataFrame, *, keep_run: bool = True) -> DataFrame:
        """(doc, sub, spans) of the windows of a batch that are repetitions, written; the batch becomes a run of the index."""
        texts = sg.keyed(docs, self.id_col, self.text_col)
        rows = fingerprints(texts, self.width)
        if keep_run:
            rows = shared.written(rows, "fingerprints")
        history = self._history()
        merged = rows if history is None else rows.unionByName(history)
        found = shared.written(sg.exchanged(merged).mapInArrow(sg.marks(False), sg.MARKS), "marks")
        shared.released(self.spark)
        compare = found.where(F.col("tag") == sg.COMPARE)
        sources = texts
        if history is not None:
            compare = compare.join(compare.where("age = 1").select("key").distinct(), "key", "left_semi")
            for old in self.batches:
                sources = sources.unionByName(sg.keyed(old, self.id_col, self.text_col))
        # Of rows equal in id and text one is asked; a document of history and batch alike has windows of either age.
        asked = compare.groupBy("doc", "sub").agg(F.collect_list(F.struct("start", "count", "age")).alias("spans"))
        windows = _window_rows(sources.select("doc", "sub", "__text").join(asked, ["doc", "sub"]), self.width)
        more = sg.exchanged(windows).mapInArrow(sg.marks(False), sg.MARKS)
        removed = found.where(F.col("tag") == sg.REMOVE).unionByName(more.where((F.col("tag") == sg.REMOVE) & (F.col("age") == 1)))
        spans = shared.written(sg.windows_of(removed.select("doc", "sub", "start", "count")), "spans")
        shared.dropped(found)
        shared.released(self.spark)
        if keep_run:
            run = f"{self.path}/run-{len(self.batches):06d}"
            rows.where(F.col("kind") == sg.FIRST).repartition("key").sortWithinPartitions("key", "content", "doc", "sub", "start").write.parquet(run)
            shared.dropped(rows)
            self.runs.append(run)
            self.batches.append(docs)
        return spans

    def compact(self) -> None:
        """Merge all runs into one that keeps, for each content, the occurrence of the earliest run."""
        if len(self.runs) < 2:
            return
        parts = None
        for i, run in enumerate(self.runs):
            one = self.spark.read.parquet(run).withColumn("run", F.lit(i))
            parts = one if parts is None else parts.unionByName(one)
        rest = [c for c in sg.FIELDS if c not in ("key", "content")]
        first = parts.groupBy("key", "content").agg(F.min(F.struct("run", "doc", "sub", "start", *[c for c in rest if c not in ("doc", "sub", "start")])).alias("x"))
        merged = f"{self.path}/compacted-{len(self.batches):06d}"
        # The aggregation has dealt the keys and contents; a run is sorted within its files.
        first.select("key", "content", "x.*").select(*sg.FIELDS).sortWithinPartitions("key", "content").write.parquet(merged)
        for run in self.runs:
            shared.remove(self.spark, run)
        self.runs = [merged]

    def strip(self, docs: DataFrame, spans: DataFrame) -> DataFrame:
        """docs with the kept words joined by one space: (__id, __text, __rest, n_words, n_removed)."""
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, counts, removed = [], [], []
                for text, spans in zip(batch["__text"], batch["spans"].to_pylist(), strict=True):
                    raw = text.as_buffer()
                    words = raw.to_pybytes().split() if raw is not None else []
                    gone = sg.covered(spans, width, len(words))
                    kept = words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    texts.append(b" ".join(kept))
                    counts.append(len(words))
                    removed.append(len(words) - len(kept))
                own = [batch["__id"], pa.array(texts, pa.binary()).cast(pa.string()), batch["__rest"], pa.array(counts, pa.int64()), pa.array(removed, pa.int64())]
                yield pa.RecordBatch.from_arrays(own, ["__id", "__text", "__rest", "n_words", "n_removed"])

        joined = sg.with_spans(sg.keyed(docs, self.id_col, self.text_col, True), spans).drop("doc", "sub")
        kinds = dict(joined.dtypes)
        return joined.mapInArrow(run, f"__id {kinds['__id']}, __text string, __rest {kinds['__rest']}, n_words long, n_removed long")


def op9_window_index(spark: SparkSession, docs: DataFrame, batches: int = 3) -> DataFrame:
    """The digest of window deduplication over all documents, inserted in ``batches`` of ascending ids (null first); the runs are compacted before the last."""
    narrow = docs.select("doc_id", "text")
    index, spans, parts = WindowIndex(spark), None, shared.id_batches(narrow, "doc_id", batches)
    for i, rows in enumerate(parts):
        last = i == len(parts) - 1
        if last:
            index.compact()
        found = index.repetitions(rows, keep_run=not last)  # nothing is inserted after the last batch
        spans = found if spans is None else spans.unionByName(found)
    out = index.strip(narrow, spans)
    return out.select(F.col("__id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.encode("__text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM words WHERE len(w) >= 20)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1
), gone AS (
  SELECT DISTINCT doc_id, i + o AS p FROM repeated, (SELECT unnest(generate_series(0, 19)) AS o)
), each AS (
  SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM words
), kept AS (
  SELECT each.doc_id, count(gone.p) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY each.p) FILTER (gone.p IS NULL), '') AS t
  FROM each LEFT JOIN gone ON each.doc_id = gone.doc_id AND each.p = gone.p GROUP BY each.doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""
