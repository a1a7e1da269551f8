"""Toxicity scores by FTRL-proximal logistic regression over hashed words, word pairs and skip pairs.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.
Features are the hashed words, pairs of neighbours and pairs with one word
between, present or not.  Per-coordinate learning rates and the L1 term leave a
sparse weight vector, which is broadcast (at most 2**bits entries).

Training takes labelled rows whose crc32(id as text) mod 5 is not 0, at most
``max_train`` of them (those with the smallest hash of their id).  Scores use
the text alone, whole.

Nulls: a null or empty text is scored by the bias alone; null labels are not
used; a null id counts as held out.  Repeated rows are scored each; of repeated
labels the largest counts, of training texts that share an id the one whose
features come first.  Without labels every score is 0.5 at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv

U64 = np.uint64
LETTERS = np.zeros(256, bool)
LETTERS[0x30:0x3A] = LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True


def features(column: pa.Array, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows: first and last row, the text number of each feature, the feature. With repetitions."""
    mask = U64((1 << bits) - 1)
    for low, high in tv.slices(column):
        data, offsets = tv.buffers(column.slice(low, high - low))
        starts, ends, first = tv.word_bounds(data, offsets, LETTERS)
        h, doc = tv.word_hashes(data, starts, ends, True), tv.owners(first)
        owner, found = [doc], [tv.mix(h) & mask]
        for gap, salt in ((1, 0x51ED270B7F4A7C15), (2, 0xA24BAED4963EE407)):
            if len(h) > gap:
                same = doc[:-gap] == doc[gap:]
                owner.append(doc[gap:][same])
                found.append((tv.mix(h[:-gap] * U64(3) + h[gap:] * U64(salt)) & mask)[same])
        yield low, high, np.concatenate(owner), np.concatenate(found).astype(np.int64)


class Ftrl:
    """FTRL-proximal for binary features; coordinate 0 of the extra entry at the end is the bias."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.1):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bits: int = 20, max_train: int = 20_000, epochs: int = 8) -> tuple[np.ndarray, np.ndarray, float]:
    """Indices and values of the weights that are not zero, and the bias."""
    key = F.col(f"`{id_col}`").cast("long")
    known = labels.select(key.alias("__label_id"), F.col(f"`{label_col}`").cast("int").alias("__label")).where("__label is not null and __label_id is not null")
    known = known.where(~_held_out(F.col("__label_id"))).groupBy("__label_id").agg(F.max("__label").alias("__label"))
    chosen = known.orderBy(F.xxhash64("__label_id"), "__label_id").limit(max_train)  # bounded, so it may be broadcast
    texts = docs.select(key.alias("__id"), F.col(f"`{text_col}`").alias("__text")).join(F.broadcast(chosen), F.col("__id") == F.col("__label_id"))
    size = 1 << bits

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for low, high, doc, feature in features(batch["__text"], bits):
                both = np.unique(doc * size + feature)
                cut = np.searchsorted(both, np.arange(high - low + 1) * size)
                rows += [(both[a:b] % size).astype(np.int32) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["__id"], batch["__label"], pa.array(rows, pa.list_(pa.int32()))], ["id", "label", "at"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(i, y, x.values.to_numpy() if x.values is not None else np.zeros(0, np.int32)) for b in batches for i, y, x in zip(b["id"].to_pylist(), b["label"].to_pylist(), b["at"], strict=True)]
        rows.sort(key=lambda r: (hash((r[0], 7)), r[0], len(r[2])))
        model = Ftrl(size)
        for _ in range(epochs):
            for _, label, at in rows:
                model.learn(np.append(at, size), label)
        found = model.weights(np.arange(size + 1))
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], ["at", "weight"])

    # One row an id, however many copies there are: what meets in one task is bounded by max_train.
    made = texts.mapInArrow(featurise, "id long, label int, at array<int>").groupBy("id", "label").agg(F.min("at").alias("at"))
    rows = made.repartition(1).mapInArrow(learn, "at long, weight double").toPandas()
    at, weight = rows["at"].to_numpy(np.int64), rows["weight"].to_numpy(float)
    bias = float(weight[at == size].sum())
    return at[at < size], weight[at < size], bias


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], *, id_col: str = "doc_id", text_col: str = "text", bits: int = 20) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    shared_model = shared_value(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, weight, bias = shared_model.value
        dense = np.zeros(1 << bits)
        dense[at] = weight
        for batch in batches:
            total = np.full(len(batch), bias)
            for low, high, doc, feature in features(batch["text"], bits):
                heavy = np.flatnonzero(dense[feature])  # few: only these need be made distinct
                both = np.unique(doc[heavy] * (1 << bits) + feature[heavy])
                total[low:high] += np.bincount(both >> bits, dense[both & ((1 << bits) - 1)], high - low)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], ["doc_id", "held_out", "score"])

    doc_id = F.col(f"`{id_col}`").cast("long")
    narrow = docs.select(doc_id.alias("doc_id"), _held_out(doc_id).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    out = narrow.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def shared_value(df: DataFrame, value):
    return df.sparkSession.sparkContext.broadcast(value)


def op5_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The score of every document, learnt from the labels that are not held out."""
    return score(docs, fit(docs, labels))
