"""Reversible line deduplication over sharded cuckoo filters and exact reference counts.

A line's key is its text without leading and trailing space and TAB..CR, with
A-Z lower-cased; keys shorter than ``min_chars`` code points never count.  The
index keeps, in the shared folder,

* postings (key, doc_id): which document holds which key,
* counts (shard, key, refs, max_doc): in how many documents a key stands and
  the largest of them,
* one cuckoo filter per shard of the key space.

Inserting a batch probes only the filter of each shard; keys it has never seen
go straight to the counts, the others are merged with their exact counts.
Deleting documents lowers the counts, and keys without references leave the
filter again, so that any insertion can be undone.

Nulls: a null or empty text is one empty line.  All rows with a null id count
as one document, smaller than any other.  Rows that repeat an id count once.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

SPACE = b" \t\n\x0b\x0c\r"
#: Keys in a shard of the filters, about.
SHARD_KEYS = 500_000


def key_of(line: bytes, min_chars: int) -> bytes | None:
    """The 128-bit key of a line, None if it is too short to count."""
    key = line.strip(SPACE)
    if len(key) < min_chars or (not key.isascii() and len(key.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key.lower())


class CuckooFilter:
    """Four 16-bit fingerprints a bucket, partial-key cuckoo hashing, bulk insertion; grows by rebuilding from the keys."""

    SLOTS, KICKS = 4, 400

    def __init__(self, table: np.ndarray):
        self.table = table  # buckets x slots; 0: free

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        buckets = 1 << max(4, int(np.ceil(np.log2(max(n, 1) / (cls.SLOTS * 0.85) + 1))))
        return cls(np.zeros((buckets, cls.SLOTS), np.uint16))

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        spread = (print_.astype(np.uint64) * np.uint64(0x5BD1E995) >> np.uint64(3)).astype(np.int64) | 1
        return bucket ^ (spread & (len(self.table) - 1))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint and first bucket of keys given as rows of two uint64."""
        print_ = ((keys[:, 0] >> np.uint64(40)) & np.uint64(0xFFFF)).astype(np.uint16)
        print_[print_ == 0] = 1
        return print_, (keys[:, 1] & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        print_, first = self._places(keys)
        second = self._other(first, print_)
        return (self.table[first] == print_[:, None]).any(1) | (self.table[second] == print_[:, None]).any(1)

    def _put(self, print_: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Store what finds a free slot; returns which did not."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        new = np.r_[True, b[1:] != b[:-1]]
        rank = np.arange(len(b)) - np.maximum.accumulate(np.where(new, np.arange(len(b)), 0))
        free = np.argsort(self.table[b] != 0, axis=1, kind="stable")  # free slots first
        room = (self.table[b] == 0).sum(1)
        fits = rank < room
        self.table[b[fits], free[fits, rank[fits]]] = print_[order][fits]
        left = np.ones(len(b), bool)
        left[order[fits]] = False
        return left

    def insert(self, keys: np.ndarray) -> bool:
        """Insert all keys; False if the table is too full (the caller then rebuilds a larger one)."""
        print_, bucket = self._places(keys)
        rng = np.random.default_rng(len(keys))
        for kick in range(self.KICKS):
            left = self._put(print_, bucket)
            print_, bucket = print_[left], self._other(bucket[left], print_[left])
            if not len(print_):
                return True
            if kick:  # one entry a bucket takes a slot; the entry it evicts goes to its other bucket
                at = np.unique(bucket, return_index=True)[1]
                where, slot = bucket[at], rng.integers(0, self.SLOTS, len(at))
                evicted = self.table[where, slot]
                self.table[where, slot] = print_[at]
                print_[at] = evicted
                bucket[at] = self._other(where, evicted)
                free = print_ != 0
                print_, bucket = print_[free], bucket[free]
        return not len(print_)

    def delete(self, keys: np.ndarray) -> None:
        """Remove one fingerprint for each key; every key must have been inserted."""
        for print_, bucket in zip(*self._places(keys), strict=True):
            for b in (bucket, int(self._other(np.array([bucket]), np.array([print_]))[0])):
                at = np.flatnonzero(self.table[b] == print_)
                if len(at):
                    self.table[b, at[0]] = 0
                    break

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        n = len(keys)
        while True:
            made = cls.sized(n)
            if made.insert(keys):
                return made
            n *= 2


def _as_words(keys: pa.Array) -> np.ndarray:
    """Binary keys of 16 bytes as rows of two uint64."""
    data = np.frombuffer(b"".join(keys.to_pylist()), np.uint64)
    return data.reshape(-1, 2)


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc_id, key) for the distinct keys of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch[0].to_pylist(), batch[1], strict=True):
                raw = text.as_buffer()
                if raw is None:
                    continue
                own = {key for line in raw.to_pybytes().split(b"\n") if len(line) >= min_chars and (key := key_of(line, min_chars)) is not None}
                keys.extend(own)
                ids.extend([doc] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "key"])

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, key binary")


class LineIndex:
    """The index of one corpus, as generations of tables below one folder; a failed step leaves the last generation as it was."""

    def __init__(self, spark: SparkSession, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20):
        self.spark, self.path = spark, path or shared.fresh_path(spark, "lines")
        self.id_col, self.text_col, self.min_chars = id_col, text_col, min_chars
        self.generation, self.shards = 0, 0

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.generation}/{name}")

    def _shard(self, shards: int):
        return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")

    @property
    def postings(self) -> DataFrame:
        return self._table("postings")

    @property
    def counts(self) -> DataFrame:
        return self._table("counts")

    def _count(self, postings: DataFrame) -> DataFrame:
        return postings.groupBy("key").agg(F.count(F.lit(1)).alias("refs"), F.max("doc_id").alias("max_doc"))

    def insert(self, docs: DataFrame) -> None:
        """Add documents; ids that the index holds already are not counted twice."""
        old = self.generation
        made = f"{self.path}/{old + 1}"
        line_keys(docs, self.id_col, self.text_col, self.min_chars).groupBy("key", "doc_id").agg(F.count(F.lit(1)).alias("rows")).write.parquet(f"{made}/new")
        new = self.spark.read.parquet(f"{made}/new")
        if old:
            had = self.postings.select(F.col("key").alias("had_key"), F.col("doc_id").alias("had_doc"))
            new = new.join(had, (F.col("key") == F.col("had_key")) & F.col("doc_id").eqNullSafe(F.col("had_doc")), "left_anti")
            self.postings.unionByName(new).write.parquet(f"{made}/postings")
        fresh = self._count(new)
        if not old:
            fresh.write.parquet(f"{made}/counts")
            self._rename(f"{made}/new", f"{made}/postings")
            self.generation = 1
            self._filters(made)
            return
        marked = shared.written(self._probe(fresh), "probed")
        known = self.counts
        sure = marked.where("not maybe").select("key", "refs", "max_doc")
        maybe = marked.where("maybe").select("key", F.col("refs").alias("r"), F.col("max_doc").alias("m"))
        merged = known.join(maybe, "key", "full").select("key", (F.coalesce("refs", F.lit(0)) + F.coalesce("r", F.lit(0))).alias("refs"), F.greatest("max_doc", "m").alias("max_doc"))
        merged.unionByName(sure).write.parquet(f"{made}/counts")
        shared.dropped(marked)
        self.generation = old + 1
        self._filters(made)

    def insert_all(self, docs: DataFrame, batches: int = 2) -> None:
        """Add documents in batches of ascending ids: from the second on, filters tell which keys need their exact counts."""
        for part in shared.id_batches(docs, self.id_col, batches):
            self.insert(part)

    def _rename(self, a: str, b: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(a)
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).rename(where, jvm.org.apache.hadoop.fs.Path(b)):
            raise OSError(f"{a} could not be renamed")

    def _filters(self, made: str) -> None:
        """Build the filter of each shard from the exact table."""
        counts = self.spark.read.parquet(f"{made}/counts")
        self.shards = max(1, -(-counts.count() // SHARD_KEYS))

        def build(key: tuple, table: pa.Table) -> pa.Table:
            keys = _as_words(table["key"])
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([CuckooFilter.of(keys).dump()], pa.binary())})

        counts.select(self._shard(self.shards), "key").groupBy("shard").applyInArrow(build, "shard int, filter binary").write.parquet(f"{made}/filters")

    def _probe(self, fresh: DataFrame) -> DataFrame:
        """fresh with ``maybe``: false where the filter of the key's shard has surely never seen it."""

        def probe(filters: pa.Table, keys: pa.Table) -> pa.Table:
            hit = CuckooFilter.load(filters["filter"][0].as_py()).contains(_as_words(keys["key"])) if len(filters) and len(keys) else np.zeros(len(keys), bool)
            return keys.select(["key", "refs", "max_doc"]).append_column("maybe", pa.array(hit))

        filters = self._table("filters").groupBy("shard")
        return filters.cogroup(fresh.withColumn("shard", self._shard(self.shards)).groupBy("shard")).applyInArrow(probe, "key binary, refs long, max_doc long, maybe boolean")

    def delete(self, ids: DataFrame) -> None:
        """Take documents (a column of ids) out again; counts, largest documents and filters are as if they had never come."""
        old, made = self._table, f"{self.path}/{self.generation + 1}"
        gone = ids.select(F.col(ids.columns[0]).cast("long").alias("gone")).distinct()
        postings = old("postings")
        postings.join(gone, F.col("doc_id").eqNullSafe(F.col("gone")), "left_anti").write.parquet(f"{made}/postings")
        touched = postings.join(gone, F.col("doc_id").eqNullSafe(F.col("gone")), "left_semi").select("key").distinct()
        left = self.spark.read.parquet(f"{made}/postings")
        recounted = self._count(left.join(touched, "key", "left_semi"))
        old("counts").join(touched, "key", "left_anti").unionByName(recounted).write.parquet(f"{made}/counts")
        removed = shared.checkpointed(touched.join(recounted, "key", "left_anti").withColumn("shard", self._shard(self.shards)))

        def take(filters: pa.Table, keys: pa.Table) -> pa.Table:
            if not len(filters):
                return filters
            f = CuckooFilter.load(filters["filter"][0].as_py())
            f.delete(_as_words(keys["key"]) if len(keys) else np.zeros((0, 2), np.uint64))
            return pa.table({"shard": filters["shard"], "filter": pa.array([f.dump()], pa.binary())})

        old("filters").groupBy("shard").cogroup(removed.groupBy("shard")).applyInArrow(take, "shard int, filter binary").write.parquet(f"{made}/filters")
        self.generation += 1

    def drops(self, min_docs: int = 3) -> DataFrame:
        """(doc_id, keys): the keys whose lines a document loses, because at least min_docs documents hold them and a larger one keeps them."""
        hot = self.counts.where(F.col("refs") >= min_docs).select("key", "max_doc")
        losing = self.postings.select("key", "doc_id").join(hot, "key").where("doc_id is null or max_doc is null or doc_id <> max_doc")
        return losing.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))

    def rewrite(self, docs: DataFrame, min_docs: int = 3) -> DataFrame:
        """docs without the lines they lose: (__id, __text, __rest) and n_lines, n_dropped."""
        min_chars = self.min_chars

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, counts, dropped = [], [], []
                for text, keys in zip(batch["__text"], batch["__keys"].to_pylist(), strict=True):
                    raw = text.as_buffer()
                    raw = b"" if raw is None else raw.to_pybytes()
                    if keys is None:
                        texts.append(raw)
                        counts.append(raw.count(b"\n") + 1)
                        dropped.append(0)
                        continue
                    lines, keys = raw.split(b"\n"), set(keys)
                    kept = [x for x in lines if len(x) < min_chars or key_of(x, min_chars) not in keys]
                    texts.append(b"\n".join(kept))
                    counts.append(len(lines))
                    dropped.append(len(lines) - len(kept))
                own = [batch["__id"], pa.array(texts, pa.binary()).cast(pa.string()), batch["__rest"], pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())]
                yield pa.RecordBatch.from_arrays(own, ["__id", "__text", "__rest", "n_lines", "n_dropped"])

        wide = shared.packed(docs, self.id_col, self.text_col)
        joined = wide.join(self.drops(min_docs).select(F.col("doc_id").alias("__doc"), F.col("keys").alias("__keys")), F.col("__id").eqNullSafe(F.col("__doc")), "left").drop("__doc")
        kinds = dict(wide.dtypes)
        return joined.mapInArrow(run, f"__id {kinds['__id']}, __text string, __rest {kinds['__rest']}, n_lines long, n_dropped long")


def op4_line_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The digest of line deduplication over all documents."""
    index = LineIndex(spark)
    index.insert_all(docs.select("doc_id", "text"))
    out = index.rewrite(docs.select("doc_id", "text"))
    return out.select(F.col("__id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.encode("__text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH split AS (
  SELECT doc_id, i, line FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS i
    FROM documents)
), keyed AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM split
), hot AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (h.key IS NOT NULL AND h.keeper <> k.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (h.key IS NULL OR h.keeper = k.doc_id), '')) AS kept_sha256
FROM keyed k LEFT JOIN hot h ON k.key = h.key AND length(k.key) >= 20
GROUP BY k.doc_id
"""
