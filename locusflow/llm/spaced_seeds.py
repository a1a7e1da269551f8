"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

Texts become sequences of word hashes (words: runs of letters, digits and
marks, lower-cased).  Each fixed mask looks at some positions of a span and
ignores the others; test and document positions whose masked hashes are equal
are joined, and around each hit the two texts are compared word by word on the
hit's diagonal.  An item leaks into a document if ``window`` consecutive words
(all its words, if it has fewer) stand in the document with at most
``2 * window // 13`` words replaced.  MASKS find every such overlap of 7 to 13
words with two (from 13), one (7 to 12) or no (5, 6) replaced words, so the
join loses none; tests enumerate all cases.

Nulls: null texts have no words; items of fewer than five words match nothing;
a null id is returned as null.  Repeated rows are one item or document as far
as their ids are equal.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASKS = ("11111", "111011", "110111")
WINDOW = 13
#: Seeds of the test side that may be broadcast: 24 bytes each, so 48 MB at most.
BROADCAST_SEEDS = 2_000_000


def _hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\p{M}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _key(h: str, at: Column, mask: str, m: int) -> Column:
    """The masked hash at a position; null where the span leaves the text."""
    own = [F.get(F.col(h), at + o) for o, c in enumerate(mask) if c == "1"]
    return F.when((at >= 0) & (at + len(mask) <= F.size(h)), F.xxhash64(F.lit(m), *own))


def allowed(window: int) -> int:
    """Words that may differ in a window."""
    return window * 2 // 13


def _seeds(side: DataFrame, h: str) -> DataFrame:
    """A row for each position and mask of side, with the masked hash there (key) and the one before (before)."""
    at = side.where(F.size(h) >= 5).withColumn("pos", F.explode(F.sequence(F.lit(0), F.size(h) - 5)))
    keys = F.array(*[F.struct(_key(h, F.col("pos"), mask, m).alias("key"), F.lit(m).alias("mask")) for m, mask in enumerate(MASKS)])
    out = at.withColumn("seed", F.explode(keys)).select(*at.columns, F.col("seed.key").alias("key"), F.col("seed.mask").alias("mask"))
    return out.where("key is not null")


def _overlap(window: int) -> Column:
    """The most equal words in any window around the hit; null if no window fits in both texts."""
    shift = F.col("pos") - F.col("item_pos")
    low = F.greatest(F.lit(0), -shift, F.col("item_pos") - F.lit(window))
    high = F.least(F.size("item_h"), F.size("h") - shift, F.col("item_pos") + F.lit(window + max(map(len, MASKS))))
    return F.transform(F.sequence(low, high - 1), lambda j: (F.get(F.col("h"), j + shift) == F.get(F.col("item_h"), j)).cast("int"))


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, window, matched): for each leak the words compared and the most that are equal.

    The test set is broadcast if its seeds, counted first, are at most
    BROADCAST_SEEDS; a larger one is joined by shuffle on the masked hash, with
    the words fetched again only for the hits.  A hit that continues the same
    mask's hit one word earlier is skipped, so a copied passage costs a few
    comparisons, not one a word.
    """
    items = benchmark.select(F.col(f"`{item_col}`").alias("item_id"), _hashes(F.col(f"`{item_text_col}`")).alias("item_h")).distinct()
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), _hashes(F.col(f"`{text_col}`")).alias("h"))
    numbered = items.withColumn("item_no", F.xxhash64("item_id", "item_h"))
    before = F.coalesce(*[F.when(F.col("mask") == m, _key("item_h", F.col("pos") - 1, mask, m)) for m, mask in enumerate(MASKS)])
    seeds = _seeds(numbered, "item_h").select("item_no", F.col("pos").alias("item_pos"), "key", "mask", before.alias("before"))
    words = numbered.select("item_no", "item_id", "item_h")
    there = F.coalesce(*[F.when(F.col("mask") == m, _key("h", F.col("pos") - 1, mask, m)) for m, mask in enumerate(MASKS)])
    first = ~F.coalesce(there == F.col("before"), F.lit(False))
    if (numbered.select(F.sum(F.size("item_h"))).first()[0] or 0) * len(MASKS) <= BROADCAST_SEEDS:
        hits = _seeds(texts, "h").join(F.broadcast(seeds.drop("mask")), "key").where(first).drop("key", "mask", "before").join(F.broadcast(words), "item_no")
    else:
        found = _seeds(texts, "h").select("doc_id", "pos", "key").join(seeds, "key").select("doc_id", "item_no", "pos", "item_pos").distinct()
        hits = found.join(texts.withColumnRenamed("doc_id", "d"), F.col("doc_id").eqNullSafe(F.col("d"))).drop("d").join(words, "item_no")
    width = F.least(F.size("item_h"), F.lit(window))
    near = hits.withColumn("eq", _overlap(window)).withColumn("window", width)
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("eq") - F.col("window") + 1), lambda s: F.aggregate(F.slice(F.col("eq"), s, F.col("window")), F.lit(0), lambda a, x: a + x)))
    near = near.where(F.size("eq") >= F.col("window")).withColumn("matched", best)
    near = near.where(F.col("window") - F.col("matched") <= F.floor(F.col("window") * 2 / 13))
    return near.groupBy("doc_id", "item_id").agg(F.max("window").cast("long").alias("window"), F.max("matched").cast("long").alias("matched"))


def op8_spaced_seeds(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and benchmark item that leaks into it."""
    return leaks(docs, benchmark)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}\p{M}]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}\p{M}]+'), lambda x: x <> '') AS w FROM benchmark
), dw AS (SELECT doc_id, len(w) AS dn, unnest(w) AS word, unnest(generate_series(0, len(w) - 1)) AS p FROM d),
bw AS (SELECT item_id, len(w) AS n, unnest(w) AS word, unnest(generate_series(0, len(w) - 1)) AS j FROM b WHERE len(w) >= 5),
same AS (SELECT doc_id, item_id, p - j AS shift, j, n, least(n, 13) AS k, least(n, dn - (p - j)) - greatest(0, j - p) AS room FROM dw JOIN bw USING (word)),
runs AS (
  SELECT doc_id, item_id, k, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY j RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS m FROM same WHERE room >= k
)
SELECT doc_id, item_id, max(k)::BIGINT AS "window", max(m)::BIGINT AS matched FROM runs WHERE k - m <= floor(k * 2 / 13) GROUP BY doc_id, item_id
"""
