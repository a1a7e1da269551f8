"""Documents whose word n-gram sets are similar, joined by adaptive multi-match prefixes.

A document's set holds its distinct shingles of ``width`` words (words: runs of
bytes other than space and TAB..CR, A-Z lower-cased); a shorter text is one
shingle.  Documents with equal sets form a class, known by its least id.  Two
sets x and y link when percent * |x or y| <= 100 * |x and y|.  Then they share
o(x) = ceil(percent * |x| / 100) elements at least, and for every k, in any one
order of all elements, k of the first |x| - o(x) + k of x and |y| - o(y) + k of y.

1. Elements are put in an order, rare ones first, by an array of hash buckets
   that mappers count and a tree adds up; the array's bounds change the order,
   never the result.
2. Every document chooses its own k: with s(k) the estimated length of the lists
   of a prefix, lists are read for s(k) and at most s(k) / k documents come to be
   verified; the k with the least cost of both is taken.  So frequent elements
   lengthen the prefix, and more of it must be shared.
3. Documents are in the lists of their prefix.  A pair that is in as many lists
   together as the smaller k of the two says is verified on full sets.

Only classes that no link joins yet are paired, as the components are asked for:
lists of more than ``FEW`` classes are first thinned, in squares of bounded size
(samples of them before all where a list is long), by links of a forest of the
pairs that seem likeliest; these are verified like others.  Pairs of sizes or of
bitmaps (512 parities of the elements) that no link can have are left out before
counting; both rules are exact.  So rows grow with classes, not with the squares
of groups.

Nulls: a null or empty text has no set and is linked with nothing; a row with a
null id has no component.  A document of several rows has the least component of
its rows.  Repeated rows stay.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import counting, shared
from . import textvec as tv
from .lsh_forest import CROWD, LEFT, NO_ID, RIGHT, STEP, _alone, _dealt, _joined, _mixed, _squares

U64 = np.uint64
#: Classes of a list that are paired as they are.
FEW = 16
#: Bits of a set's bitmap, and of the buckets' blocks.
MAP, BLOCK_BITS = 512, 20
#: Bytes of the Arrow batches in which texts come to Python: each task has one in the JVM and one in its worker.
BATCH = 4 << 20
#: Costs: of a row of a prefix, of an entry of a list, of a verification and of each element of it.
ROW, ENTRY, VERIFY, ELEMENT = 4.0, 1.0, 8.0, 0.1


def sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows: first and last row, the distinct shingles of each text in ascending order, and the first of each text."""
    for low, high in tv.slices(column):
        data, offsets = tv.buffers(column.slice(low, high - low))
        starts, ends, first = tv.word_bounds(data, offsets)
        words = tv.word_hashes(data, starts, ends, True)
        at = tv.windows_inside(first, width)
        grams = tv.grams(words, width)[at] if len(at) else np.zeros(0, U64)
        owner = np.searchsorted(first, at, "right") - 1
        short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < width))
        if len(short):
            grams = np.concatenate((grams, tv.range_hashes(words, first[short], first[short + 1], 1)))
            owner = np.concatenate((owner, short))
        order = np.lexsort((grams, owner))
        grams, owner = grams[order], owner[order]
        new = np.r_[True, (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])] if len(grams) else np.zeros(0, bool)
        grams, owner = grams[new], owner[new]
        yield low, high, grams, np.searchsorted(owner, np.arange(high - low + 1))


def bitmaps(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MAP parities of each set, as rows of 64-bit words: two sets' maps differ in no more bits than the sets in elements."""
    out = np.zeros((len(first) - 1, MAP // 64), U64)
    owner = tv.owners(first)
    place = (tv.mix(grams + U64(11)) & U64(MAP - 1)).astype(np.int64)
    np.bitwise_xor.at(out, (owner, place >> 6), U64(1) << (place & 63).astype(U64))
    return out


MADE = f"doc long, n_shingles long, a long, b long, bits binary, {counting.PART}"
_MADE = pa.schema([("doc", pa.int64()), ("n_shingles", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("bits", pa.binary()), ("block", pa.int32()), ("mapper", pa.int32()), ("at", pa.binary()), ("n", pa.binary())])


def _described(width: int, bits: int):
    """Each row's set size, digest and bitmap; and counts of the shingles' buckets, an array for each mapper."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for low, high, grams, first in sets(batch["__text"], width):
                digests = [tv.range_hashes(grams, first[:-1], first[1:], i).view(np.int64) for i in (0, 1)]
                maps = pa.array([m.tobytes() for m in bitmaps(grams, first)], pa.binary())
                columns = [batch["doc"].slice(low, high - low), pa.array(np.diff(first)), *map(pa.array, digests), maps]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(high - low, k.type) for k in list(_MADE)[5:])], schema=_MADE)
                at, n = np.unique(grams >> U64(64 - bits), return_counts=True)
                total[at.astype(np.int64)] += n.astype(np.uint32)
        size = 1 << min(BLOCK_BITS, bits)
        rows = [counting.packed(k, TaskContext.get().partitionId(), at, part[at]) for k, part in enumerate(total.reshape(-1, size)) if len(at := np.flatnonzero(part))]
        if rows:
            parts = [pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), list(_MADE)[5:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(rows), k.type) for k in list(_MADE)[:5]), *parts], schema=_MADE)

    return run


def frequencies(parts: DataFrame, bits: int) -> np.ndarray:
    """Counts of all buckets, rounded on a logarithmic scale to a byte each: 2 ** bits bytes in the driver."""
    block_bits = min(BLOCK_BITS, bits)

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at, n in zip(batch["at"].to_pylist(), batch["n"].to_pylist(), strict=True):
                at, n = counting.unpacked(at, n)
                codes = np.zeros(1 << block_bits, np.uint8)
                codes[at] = np.minimum(np.round(np.log2(n + 1.0) * 6), 255)
                out.append(codes.tobytes())
            yield pa.RecordBatch.from_arrays([batch["block"], pa.array(out, pa.binary())], ["block", "codes"])

    codes = np.zeros(1 << bits, np.uint8)
    for row in counting.tree_sum(parts).mapInArrow(scaled, "block int, codes binary").collect():
        codes[row.block << block_bits : row.block + 1 << block_bits] = np.frombuffer(row.codes, np.uint8)
    return codes


def chosen(size: int, lists: np.ndarray, percent: int) -> int:
    """The k of least cost for a set whose elements, in order, have lists of these estimated lengths."""
    least = -(-percent * size // 100)
    k = np.arange(1, least + 1)
    length = size - least + k
    read = np.cumsum(lists)[length - 1]
    return int(k[np.argmin(ROW * length + ENTRY * read + (VERIFY + ELEMENT * size) * read / k)])


def prefixes(docs: DataFrame, codes, bits: int, width: int, percent: int) -> DataFrame:
    """(region, doc, k): the elements of each document's prefix, rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codes.value
        spread = np.exp2(np.arange(256) / 6) - 1
        usual = float(spread[own].mean())  # what other elements add to a bucket
        for batch in batches:
            doc = batch["doc"].to_numpy()
            for low, high, grams, first in sets(batch["__text"], width):
                owner = tv.owners(first)
                code = own[(grams >> U64(64 - bits)).astype(np.int64)]
                order = np.lexsort((tv.mix(grams + U64(5)), code, owner))
                grams, code = grams[order], code[order]
                lists = np.maximum(spread[code] - usual, 0)
                k = np.zeros(high - low, np.int64)
                for i in np.flatnonzero(np.diff(first)).tolist():
                    k[i] = chosen(int(first[i + 1] - first[i]), lists[first[i] : first[i + 1]], percent)
                n = np.diff(first)
                length = np.where(n > 0, n - -(-percent * n // 100) + k, 0)
                at = np.flatnonzero(np.arange(len(grams)) - first[:-1][owner] < length[owner])
                columns = (grams[at].view(np.int64), doc[low:high][owner[at]], k[owner[at]].astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["region", "doc", "k"])

    return docs.mapInArrow(run, "region long, doc long, k int")


def _possible(batch: pa.RecordBatch, left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of rows may link, by sizes, bitmaps and components, and in how many elements the maps say that they differ."""
    maps = np.frombuffer(b"".join(batch["bits"].to_pylist()), U64).reshape(batch.num_rows, -1)
    n, component = batch["n_shingles"].to_numpy(), batch["component"].to_numpy()
    differ = np.zeros((len(left), len(right)), np.int64)
    for j in range(maps.shape[1]):
        differ += np.bitwise_count(maps[left, j][:, None] ^ maps[right, j][None])
    both = n[left][:, None] + n[right][None]
    # They share (both - difference) / 2 elements, of (both + difference) / 2: percent * union <= 100 * shared bounds the difference.
    fits = (percent + 100) * differ <= (100 - percent) * both
    fits &= (percent * n[left][:, None] <= 100 * n[right][None]) & (percent * n[right][None] <= 100 * n[left][:, None])
    return fits & (component[left][:, None] != component[right][None]), differ / both


def _pairs(dealt: DataFrame, percent: int, sparse: bool) -> DataFrame:
    """(region, x, y) of the pairs in squares that may link: all of them, or the least different ones that form a forest of components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first in _squares(batches):
            region, node, kind, component = (batch[c].to_numpy() for c in ("region", "node", "kind", "component"))
            out = []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                part, k = batch.slice(a, b - a), kind[a:b]
                left, right = np.flatnonzero(k != RIGHT), np.flatnonzero(k != LEFT)
                fits, away = _possible(part, left, right, percent)
                x, y = _forest(fits, away, component[a:b][left], component[a:b][right]) if sparse else np.nonzero(fits)
                out.append((np.full(len(x), region[a]), node[a + left[x]], node[a + right[y]]))
            r, x, y = (np.concatenate(c) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (r, np.minimum(x, y), np.maximum(x, y))], ["region", "x", "y"])

    return dealt.repartition("region", "i", "j").sortWithinPartitions("region", "i", "j").mapInArrow(run, "region long, x long, y long")


def _forest(fits: np.ndarray, away: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that join all components which possible pairs connect, the least different first, in rounds."""
    names, ends = np.unique(np.concatenate((rows, columns)), return_inverse=True)
    label = np.arange(len(names))
    mine, theirs = ends[: len(rows)], ends[len(rows) :]
    cost = np.where(fits, away, np.inf)
    out = []
    while True:
        cost[label[mine][:, None] == label[theirs][None]] = np.inf
        best = cost.argmin(1) if cost.size else np.zeros(0, np.int64)
        price = cost[np.arange(len(best)), best]
        order = np.lexsort((price, label[mine]))
        order = order[np.isfinite(price[order])]
        if not len(order):
            break
        own = label[mine[order]]
        for i in order[np.r_[True, own[1:] != own[:-1]]].tolist():
            one, two = label[mine[i]], label[theirs[best[i]]]
            if one != two:
                label[label == max(one, two)] = min(one, two)
                out.append((i, best[i]))
    x, y = (np.array(c, np.int64) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
    return x, y


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (x, y) that link by their full sets, written; of documents of several rows any one decides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, one = [], None, None
            for i, (a, b) in enumerate(zip(batch["text_x"].to_pylist(), batch["text_y"].to_pylist(), strict=True)):
                if a != last:
                    one, last = next(sets(pa.array([a], pa.string()), width))[2], a
                two = next(sets(pa.array([b], pa.string()), width))[2]
                both = len(np.intersect1d(one, two, assume_unique=True))
                if both and 100 * both >= percent * (len(one) + len(two) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch[c].take(pa.array(keep, pa.int64())) for c in ("x", "y")], ["x", "y"])

    ids = pairs.select(F.col("x").alias("doc")).union(pairs.select(F.col("y").alias("doc")))
    own = shared.written(shared.only(texts, ids, "doc"), "texts")
    both = pairs.join(own.select(F.col("doc").alias("x"), F.col("__text").alias("text_x")), "x").join(own.select(F.col("doc").alias("y"), F.col("__text").alias("text_y")), "y")
    with shared.batches_of(shared.session(texts), BATCH):
        true = shared.written(both.mapInArrow(run, "x long, y long").distinct(), "links")
    shared.dropped(own)
    return true


def _merged(component: DataFrame, links: DataFrame) -> DataFrame:
    """component (node, component) after links (x, y) between nodes."""
    ends = [component.select(F.col("node").alias(e), F.col("component").alias(to)) for e, to in (("x", "a"), ("y", "b"))]
    return _joined(component, links.join(ends[0], "x").join(ends[1], "y").select("a", "b"))


def _thinned(members: DataFrame, known: DataFrame, texts: DataFrame, component: DataFrame, width: int, percent: int) -> DataFrame:
    """component after verified links of forests in the lists of more than FEW classes; these need not find all."""
    sizes = members.groupBy("region").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > FEW)
    long = shared.written(members.join(sizes, "region"), "long")
    widest = long.agg(F.max("size")).first()[0] or 0
    some, many = (long.where(c).drop("size") for c in (F.col("size") <= CROWD, F.col("size") > CROWD))
    sample, more = 1, widest > 0
    while more:
        dealt = _dealt(some, component, 1).unionByName(_dealt(many, component, 1, sample)) if widest > CROWD else _dealt(some, component, 1)
        asked = shared.written(_pairs(dealt.join(known, "node"), percent, True).select("x", "y").distinct(), "asked")
        true = verified(asked, texts, width, percent)
        links, asked_for = true.count(), asked.count()
        if links:
            before, component = component, _merged(component, true)
            shared.dropped(before)
        counting.dropped(asked, true)
        if 4 * links < max(asked_for, 1):  # little is found at this depth
            sample *= STEP
            more = widest > CROWD and sample * CROWD < widest
    shared.dropped(long)
    return component


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """(doc, n_shingles) of every row and (doc, component) of every document with a set."""
    spark = shared.session(docs)
    wide = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("doc"), F.col(f"`{text_col}`").alias("__text"))
    bits = counting.bits_for(wide, "__text", 256, 12, 24)
    with shared.batches_of(spark, BATCH):
        made = shared.written(wide.mapInArrow(_described(width, bits), MADE), "sets")
    codes = spark.sparkContext.broadcast(frequencies(made.where("block is not null").select("block", "mapper", "at", "n"), bits))
    made = made.where("block is null").select("doc", "n_shingles", "a", "b", "bits")
    own = made.where((F.col("n_shingles") > 0) & (F.col("doc") != NO_ID))
    classes = own.groupBy("a", "b").agg(F.min("doc").alias("node"), F.max("bits").alias("bits"), F.max("n_shingles").alias("n_shingles"))
    classes = shared.written(classes, "classes")
    # A document's class by its digest; hot classes are left to the join's skew handling.
    placed = own.select("doc", "a", "b").distinct().join(classes.select("a", "b", "node"), ["a", "b"]).select("doc", "node").distinct()
    placed = shared.written(placed, "placed")
    texts = wide.where(F.col("doc") != NO_ID)
    with shared.batches_of(spark, BATCH):
        rows = shared.written(prefixes(texts, codes, bits, width, percent), "prefixes")
    several = rows.groupBy("region").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi").select("region")
    listed = rows.join(several, "region").join(placed, "doc").groupBy("region", "node").agg(F.min("k").alias("k"))
    listed = shared.written(listed, "lists")
    members = listed.select("region", F.lit(0).alias("tree"), "node")
    needed = listed.groupBy("node").agg(F.min("k").alias("k"))
    known = shared.written(classes.join(needed, "node").select("node", "bits", "n_shingles", "k"), "known")
    component = _thinned(members, known, texts, shared.written(_alone(classes), "components"), width, percent)
    near = _pairs(_dealt(members, component, 1).join(known, "node"), percent, False)
    shares = near.groupBy("x", "y").agg(F.count_distinct("region").alias("shared"))
    k_of = lambda e: known.select(F.col("node").alias(e), F.col("k").alias(f"k_{e}"))
    asked = shared.written(shares.join(k_of("x"), "x").join(k_of("y"), "y").where(F.col("shared") >= F.least("k_x", "k_y")).select("x", "y").distinct(), "asked")
    true = verified(asked, texts, width, percent)
    component = _merged(component, true)
    members = shared.written(placed.join(component, "node").groupBy("doc").agg(F.min("component").alias("component")), "members")
    counting.dropped(rows, listed, known, classes, placed, asked, true, component)
    codes.destroy()
    return made.select("doc", "n_shingles"), members


def op12_prefix_join(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The groups of all documents."""
    rows, members = groups(docs.select("doc_id", "text"))
    own = F.when(F.col("doc") != NO_ID, F.col("doc"))
    out = rows.join(members, "doc", "left")
    return out.select(own.alias("doc_id"), "n_shingles", F.when(own.isNotNull(), F.coalesce("component", "doc")).alias("component_id"))


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [hash(array_to_string(w, ' '))]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: hash(array_to_string(w[i:i + 2], ' ')))) END AS s FROM words
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), ranked AS (
  SELECT doc_id, n, g, row_number() OVER (PARTITION BY doc_id ORDER BY f, g) AS place FROM (SELECT *, count(*) OVER (PARTITION BY g) AS f FROM items)
), rare AS MATERIALIZED (
  SELECT * FROM ranked WHERE 10 * place <= n + 10
), near AS MATERIALIZED (
  SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM rare a JOIN rare b ON a.g = b.g AND a.doc_id <> b.doc_id AND 90 * a.n <= 100 * b.n AND 90 * b.n <= 100 * a.n
), links AS MATERIALIZED (
  SELECT x, y FROM (SELECT x, y, len(a.s) AS n, len(b.s) AS m, len(list_intersect(a.s, b.s)) AS k FROM near JOIN sets a ON x = a.doc_id JOIN sets b ON y = b.doc_id) WHERE 100 * k >= 90 * (n + m - k)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, c AS component_id FROM sets JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) ON x = doc_id
"""
