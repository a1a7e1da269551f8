"""Near-duplicate groups by an LSH forest over MinHash signatures.

A document's set holds its distinct five-word shingles (words: runs of bytes
other than space and TAB..CR, A-Z lower-cased), a shorter text is one shingle.
Documents with equal sets form a class, known by its least id.  Each of
``trees`` orders arranges the classes by ``depth`` MinHash values of its own.
A region is what shares the first ``least`` values of an order; its classes are
candidates of one another, and depth adapts to the region:

1. where at most ``CROWD`` classes meet, all their pairs are compared;
2. crowded regions are sorted by the whole key first, and the neighbours with
   the longest common prefix are confirmed in rounds, the most similar one of
   each component, as long as these find links.  A large group becomes a few
   components at the price of some candidates a class;
3. what then lies outside a region's largest component is compared with the
   whole region, in squares of CROWD by CROWD classes.  Where regions are
   crowded, samples of the squares come first, each some times the one before,
   and what they link is one component in the next.  Links found between
   components then grow with the classes, not with the squares.

So every pair that shares ``least`` values of an order ends in one component or
is compared, whatever the number of partitions.  Comparison is by all MinHash
values first and by the full sets of the classes that remain.  Only these
classes' texts are shuffled.  No group meets in one task: regions are found by
aggregation, joins split hot keys, squares are bounded.

Nulls: a null or empty text has no set and is linked with nothing; a row with a
null id has no component and is not kept as one.  Rows that share an id are one
document for linking.  Repeated rows stay.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from . import textvec as tv

U64 = np.uint64
NO_ID = -(1 << 63)
SHINGLE = 5
#: A pair whose estimated similarity is lower by this much is not confirmed: over 4.5 standard deviations at 120 values.
SLACK = 0.15
#: The same in the rounds that shrink groups, which need not find all.
LIKELY = 0.05
#: Classes of a region that are compared as they are, and rows of a square's side.
CROWD = 512
#: Neighbours of other components looked at before each row of a crowded region.
REACH = 8


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows: first and last row, the distinct shingles sorted by text, and the first of each text."""
    for low, high in tv.slices(column):
        data, offsets = tv.buffers(column.slice(low, high - low))
        starts, ends, first = tv.word_bounds(data, offsets)
        words = tv.word_hashes(data, starts, ends, True)
        at = tv.windows_inside(first, SHINGLE)
        grams = tv.grams(words, SHINGLE)[at] if len(at) else np.zeros(0, U64)
        owner = np.searchsorted(first, at, "right") - 1
        short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < SHINGLE))
        if len(short):
            whole = tv.range_hashes(words, first[short], first[short + 1], 1)
            grams, owner = np.concatenate((grams, whole)), np.concatenate((owner, short))
        order = np.lexsort((grams, owner))
        grams, owner = grams[order], owner[order]
        new = np.r_[True, (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])] if len(grams) else np.zeros(0, bool)
        grams, owner = grams[new], owner[new]
        yield low, high, grams, np.searchsorted(owner, np.arange(high - low + 1))


def _multipliers(n: int) -> np.ndarray:
    return tv.mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def signatures(docs: DataFrame, functions: int) -> DataFrame:
    """(doc, n_shingles, a, b, sig) of rows (doc, __text): a 128-bit digest of the set and its MinHash values as 32-bit words."""
    schema = "doc long, n_shingles long, a long, b long, sig binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _multipliers(functions)
        for batch in batches:
            doc = batch["doc"]
            for low, high, grams, first in shingle_sets(batch["__text"]):
                n = np.diff(first)
                some = np.flatnonzero(n)
                digests = [tv.range_hashes(grams, first[:-1], first[1:], i).view(np.int64) for i in (0, 1)]
                values = np.full((high - low, functions), 0xFFFFFFFF, np.uint32)
                if len(some):
                    for j, factor in enumerate(factors):
                        h = (grams * factor) >> U64(32)  # shingles are mixed already: the high half of an odd multiple is a new order
                        values[some, j] = np.minimum.reduceat(h, first[:-1][some]).astype(np.uint32)
                sig = pa.array([x.tobytes() for x in values.astype(">u4")], pa.binary())
                names = [x.split()[0] for x in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([doc.slice(low, high - low), pa.array(n.astype(np.int64)), pa.array(digests[0]), pa.array(digests[1]), sig], names)

    return docs.select("doc", "__text").mapInArrow(run, schema)


def _values(column: pa.Array) -> np.ndarray:
    """The MinHash values of a column of signatures, a row each."""
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").astype(np.uint32).reshape(len(column), -1)


def _neighbours(ordered: DataFrame, reach: int, threshold: float) -> DataFrame:
    """(x, y, cx, cy, share): for sorted rows (region, node, component, sig) the most similar of up to ``reach`` preceding rows of another component, if its MinHash values agree in ``threshold`` of all orders."""
    names = ["x", "y", "cx", "cy", "share"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            if not batch.num_rows:
                continue
            c = [batch[x].to_numpy() for x in ("region", "node", "component")] + [_values(batch["sig"])]
            if carry is not None:
                c = [np.concatenate((a, b)) for a, b in zip(carry, c, strict=True)]
            new = 0 if carry is None else len(carry[0])
            carry = [x[-reach:] for x in c]
            region, node, component, values = c
            best, other = np.zeros(len(node)), np.full(len(node), -1)
            for lag in range(1, min(reach, len(node) - 1) + 1):
                at = np.flatnonzero((region[lag:] == region[:-lag]) & (component[lag:] != component[:-lag])) + lag
                at = at[at >= new]
                for low in range(0, len(at), 4096):
                    part = at[low : low + 4096]
                    share = (values[part] == values[part - lag]).mean(1)
                    better = share > best[part]
                    best[part[better]], other[part[better]] = share[better], part[better] - lag
            at = np.flatnonzero((other >= 0) & (best >= threshold))
            to = other[at]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[at], node[to], component[at], component[to], best[at])], names)

    return ordered.mapInArrow(run, "x long, y long, cx long, cy long, share double")


def _confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y, text_x, text_y) with 100 * intersection >= percent * union of their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, one = [], None, None
            for i, (a, b) in enumerate(zip(batch["text_x"].to_pylist(), batch["text_y"].to_pylist(), strict=True)):
                if a != last:
                    one, last = next(shingle_sets(pa.array([a], pa.string())))[2], a
                two = next(shingle_sets(pa.array([b], pa.string())))[2]
                both = len(np.intersect1d(one, two, assume_unique=True))
                if both and 100 * both >= percent * (len(one) + len(two) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch[c].take(pa.array(keep, pa.int64())) for c in ("x", "y")], ["x", "y"])

    return pairs.mapInArrow(run, "x long, y long")


def _texts_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of texts whose doc is in ids (doc), written."""
    return shared.written(shared.only(texts, ids, "doc"), "texts")


def _links(texts: DataFrame, near: DataFrame, percent: int) -> DataFrame:
    """The pairs near (x, y) that are links, written; of rows that share an id each is compared."""
    own = _texts_of(texts, near.select(F.col("x").alias("doc")).union(near.select(F.col("y").alias("doc"))))
    both = near.join(own.select(F.col("doc").alias("x"), F.col("__text").alias("text_x")), "x").join(own.select(F.col("doc").alias("y"), F.col("__text").alias("text_y")), "y")
    true = shared.written(_confirmed(both, percent).distinct(), "links")
    shared.dropped(own)
    return true


def _joined(component: DataFrame, links: DataFrame) -> DataFrame:
    """component (node, component) after links (a, b) between components."""
    merged = shared.components(links).select(F.col("node").alias("component"), F.col("component").alias("into"))
    return shared.written(component.join(merged, "component", "left").select("node", F.coalesce("into", "component").alias("component")), "components")


def _mixed(members: DataFrame, component: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (region, tree, node) with their component, and (region, n, main, rest) of the regions with several: main the largest one, rest the rows outside."""
    own = members.join(component, "node")
    by = own.groupBy("region", "component").agg(F.count(F.lit(1)).alias("m"))
    regions = by.groupBy("region").agg(F.sum("m").alias("n"), F.max(F.struct("m", "component")).alias("top"), F.count(F.lit(1)).alias("kinds"))
    return own, regions.where("kinds > 1").select("region", "n", F.col("top.component").alias("main"), (F.col("n") - F.col("top.m")).alias("rest"))


def _alone(nodes: DataFrame) -> DataFrame:
    """Each node as a component."""
    return nodes.select("node").distinct().select("node", F.col("node").alias("component"))


def _shrunk(members: DataFrame, signed: DataFrame, texts: DataFrame, depth: int, percent: int) -> DataFrame:
    """(node, component) of the nodes in crowded regions, after rounds over neighbours; these need not find all links."""
    spark = shared.session(members)
    large = members.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).select("region")
    crowded = shared.written(members.join(large, "region"), "crowded")
    component, more = shared.written(_alone(crowded), "components"), not crowded.isEmpty()
    signed = signed.join(crowded.select("node").distinct(), "node", "left_semi")
    while more:
        own, regions = _mixed(crowded, component)
        rows = own.join(regions.where(F.col("rest") > CROWD // 4).select("region"), "region").join(signed, "node")
        # The tie order changes with the components.
        order = ["region", F.expr(f"substring(sig, 1 + {4 * depth} * tree, {4 * depth})"), F.xxhash64("node", "component")]
        ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("region", "node", "component", "sig")
        ends = _neighbours(ordered, REACH, percent / 100 - LIKELY).select(F.explode(F.array("cx", "cy")).alias("c"), "share", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        near = shared.written(ends.groupBy("c").agg(F.max(F.struct("share", "x", "y")).alias("m")).select("m.x", "m.y").distinct(), "asked")
        true = _links(texts, near, percent)
        ends = [component.select(F.col("node").alias(e), F.col("component").alias(to)) for e, to in (("x", "a"), ("y", "b"))]
        links = true.count()
        more = links > 0 and 4 * links >= near.count()  # a round that finds less than a link for four pairs is the last
        if links:
            before, component = component, _joined(component, true.join(ends[0], "x").join(ends[1], "y").select("a", "b"))
            shared.dropped(before)
        for table in (near, true):
            shared.dropped(table)
        rows = ordered = ends = None
        shared.released(spark)
    shared.dropped(crowded)
    return component


#: Which side of a square a row stands on.
LEFT, RIGHT, BOTH = 0, 1, 2
#: A sample of the squares has so many times the squares of the one before.
STEP = 8


def _dealt(members: DataFrame, component: DataFrame, trees: int, sample: int | None = None) -> DataFrame:
    """(region, i, j, kind, tree, node, component): the squares in which all rows outside a region's main component meet all of the region.

    Diagonals of crowded regions' squares have ranks, in each tree the first one, then the second ones and so on; a
    sample has the ranks below ``sample`` only.  All rows outside the main component are in each diagonal.
    """
    own, regions = _mixed(members if sample is None else members.where(F.col("tree") < sample), component)
    if sample is not None:
        regions = regions.where(F.col("n") > CROWD)
    parts = lambda c: F.ceil(F.col(c) / CROWD).cast("int")
    rows = own.join(regions.select("region", "main", parts("rest").alias("down"), parts("n").alias("across")), "region")
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    all_of = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    outside = F.col("component") != F.col("main")
    square = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("is"), j.alias("js"))
    left, right = square(LEFT, F.array(part("down")), all_of("across")), square(RIGHT, all_of("down"), F.array(part("across")))
    one = F.when(outside, F.array(square(BOTH, F.array(F.lit(0)), F.array(F.lit(0))))).otherwise(F.array(square(RIGHT, F.array(F.lit(0)), F.array(F.lit(0)))))
    sides = F.when(F.col("across") == 1, one).otherwise(F.when(outside, F.array(left, right)).otherwise(F.array(right)))
    rows = rows.select("region", "tree", "node", "component", "across", F.explode(sides).alias("s")).select("region", "tree", "node", "component", "across", "s.kind", F.explode("s.is").alias("i"), "s.js")
    if sample is not None:
        rows = rows.withColumn("js", F.filter("js", lambda j: F.col("tree") + trees * F.pmod(j - F.col("i"), F.col("across")) < sample))
    return rows.select("region", "i", F.explode("js").alias("j"), "kind", "tree", "node", "component")


def _squares(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of whole squares of rows sorted by (region, i, j), with the first row of each and the end."""
    carry = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if carry is not None:
            batch = pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0]
        key = np.stack([batch[c].to_numpy() for c in ("region", "i", "j")])
        first = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)])
        if len(first) > 1:
            yield batch.slice(0, int(first[-1])), first
        carry = batch.slice(int(first[-1]))
    if carry is not None:
        yield carry, np.array([0, carry.num_rows])


def _likely(dealt: DataFrame, trees: int, least: int, threshold: float) -> DataFrame:
    """The rows of squares (with sig) that have a partner in another component whose MinHash values agree in ``threshold``; a pair counts in the first tree that it shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first in _squares(batches):
            values, kind, component, tree = _values(batch["sig"]), batch["kind"].to_numpy(), batch["component"].to_numpy(), batch["tree"].to_numpy()
            flag = np.zeros(len(kind), bool)
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                left, right = a + np.flatnonzero(kind[a:b] != RIGHT), a + np.flatnonzero(kind[a:b] != LEFT)
                own = values[right]
                step = max(1, (1 << 22) // (len(right) * values.shape[1] + 1))
                for low in range(0, len(left), step):
                    some = left[low : low + step]
                    equal = values[some][:, None, :] == own[None]
                    x, y = np.nonzero((equal.mean(2) >= threshold) & (component[some][:, None] != component[right][None]))
                    if len(x):
                        shares = equal[x, y].reshape(len(x), trees, -1)[:, :, :least].all(2)
                        here = shares.argmax(1) == tree[a]
                        flag[some[x[here]]] = True
                        flag[right[y[here]]] = True
            at = pa.array(np.flatnonzero(flag))
            yield pa.RecordBatch.from_arrays([batch[c].take(at) for c in ("region", "i", "j", "kind", "node", "component")], ["region", "i", "j", "kind", "node", "component"])

    return dealt.repartition("region", "i", "j").sortWithinPartitions("region", "i", "j").mapInArrow(run, "region long, i int, j int, kind int, node long, component long")


def _square_links(dealt: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each square of rows with __text enough links between components to connect what its full sets connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first in _squares(batches):
            kind, component = batch["kind"].to_numpy(), batch["component"].to_numpy()
            found, ends = zip(*((grams, at) for _, _, grams, at in shingle_sets(batch["__text"])), strict=True)
            grams, size = np.concatenate(found), np.concatenate([np.diff(at) for at in ends])
            at = np.concatenate(([0], np.cumsum(size)))
            links = []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                _, ids = np.unique(grams[at[a] : at[b]], return_inverse=True)
                offset, n, own = at[a:b] - at[a], size[a:b], component[a:b]
                root = {c: c for c in own.tolist()}

                def top(c: int, root: dict[int, int] = root) -> int:
                    while root[c] != c:
                        root[c] = root[root[c]]
                        c = root[c]
                    return c

                mark = np.zeros(len(ids), bool)
                for x in np.flatnonzero((kind[a:b] != RIGHT) & (n > 0)).tolist():
                    mark[ids[offset[x] : offset[x] + n[x]]] = True
                    total = np.concatenate(([0], np.cumsum(mark[ids])))
                    both = total[offset + n] - total[offset]
                    mark[:] = False
                    for y in np.flatnonzero((100 * both >= percent * (n + n[x] - both)) & (n > 0) & (own != own[x])).tolist():
                        one, two = top(int(own[x])), top(int(own[y]))
                        if one != two:
                            root[max(one, two)] = min(one, two)
                            links.append((one, two))
            pairs = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return dealt.repartition("region", "i", "j").sortWithinPartitions("region", "i", "j").mapInArrow(run, "a long, b long")


def _compared(dealt: DataFrame, signed: DataFrame, texts: DataFrame, component: DataFrame, trees: int, least: int, percent: int) -> DataFrame:
    """component (node, component), written, after the links that full sets have in the squares."""
    likely = shared.written(_likely(dealt.join(signed, "node"), trees, least, percent / 100 - SLACK), "likely")
    shared.released(shared.session(texts))
    own = _texts_of(texts, likely.select(F.col("node").alias("doc")))
    joined = _joined(component, _square_links(likely.join(own.withColumnRenamed("doc", "node"), "node"), percent))
    for table in (own, likely, component):
        shared.dropped(table)
    return joined


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, trees: int = 20, depth: int = 6, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """(doc, n_shingles) of every row and (doc, component) of every document with a set; no text is shuffled but of candidates.

    A pair at 85 % shares three values (``least``) of no order with a probability
    of about 5e-9, one at 80 %, as the pipeline asks for, of 6e-7; the estimate
    from 120 values is further than SLACK below the truth with 3e-6 at most.
    All other pairs are joined or compared exactly.
    """
    spark = shared.session(docs)
    wide = shared.packed(docs, id_col, text_col).withColumn("doc", F.coalesce(F.col("__id").cast("long"), F.lit(NO_ID)))
    made = shared.written(signatures(wide, trees * depth), "minhash")
    # One row a class; equal sets have equal values, so any row's signature stands for all.
    known = made.where((F.col("n_shingles") > 0) & (F.col("doc") != NO_ID))
    classes = shared.written(known.groupBy("a", "b").agg(F.min("doc").alias("node"), F.max("sig").alias("sig")), "classes")
    heads = F.array(*[F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), F.substring("sig", 1 + 4 * depth * t, 4 * least)).alias("region")) for t in range(trees)])
    heads = classes.select("node", F.explode(heads).alias("h")).select("h.region", "h.tree", "node")
    several = heads.groupBy("region").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("region")
    members = shared.written(heads.join(several, "region").distinct(), "members")
    signed = shared.written(classes.select("node", "sig").join(members.select("node").distinct(), "node", "left_semi"), "signatures")
    shared.released(spark)
    texts = wide.where(F.col("doc") != NO_ID).select("doc", "__text")
    # Rows that share an id but not their set: one node of several classes, linked already.
    shrunk = _shrunk(members, signed, texts, depth, percent)
    component = shared.written(_alone(classes.select("node")).join(shrunk.withColumnRenamed("component", "into"), "node", "left").select("node", F.coalesce("into", "component").alias("component")), "components")
    widest = -(-(_mixed(members, component)[1].agg(F.max("n")).first()[0] or 0) // CROWD)
    sample = 1
    while widest > 1 and 2 * sample <= widest * trees:
        component = _compared(_dealt(members, component, trees, sample), signed, texts, component, trees, least, percent)
        sample *= STEP
    component = _compared(_dealt(members, component, trees), signed, texts, component, trees, least, percent)
    for table in (members, signed):
        shared.dropped(table)
    shared.released(spark)
    grouped = classes.select("a", "b", "node").join(component, "node").select(F.col("a").alias("ca"), F.col("b").alias("cb"), "component")
    # A document's own digest finds its class; hot classes are left to the join's skew handling.
    of_rows = shared.written(made.select("doc", "n_shingles", "a", "b").distinct().join(grouped, (F.col("a") == F.col("ca")) & (F.col("b") == F.col("cb")) & (F.col("n_shingles") > 0), "left").where("component is not null").groupBy("doc").agg(F.min("component").alias("component")), "members")
    return made.select("doc", "n_shingles"), of_rows


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """Every row of docs as (__id, __text, __rest, component_id, kept)."""
    _, members = groups(docs, id_col=id_col, text_col=text_col, **parameters)
    own = F.col("__id").cast("long")
    joined = shared.packed(docs, id_col, text_col).join(members, own == F.col("doc"), "left").drop("doc")
    joined = joined.withColumn("component_id", F.when(own.isNotNull(), F.coalesce("component", own))).drop("component")
    return joined.withColumn("kept", F.coalesce(F.col("component_id") == own, F.lit(False)))


def op3_lsh_forest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The groups of all documents."""
    rows, members = groups(docs.select("doc_id", "text"))
    own = F.when(F.col("doc") != NO_ID, F.col("doc"))
    component = F.when(own.isNotNull(), F.coalesce("component", "doc"))
    out = rows.join(members, "doc", "left")
    return out.select(own.alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(component == own, F.lit(False)).alias("kept"))


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [hash(array_to_string(w, ' '))]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: hash(array_to_string(w[i:i + 4], ' ')))) END AS s FROM words
), items AS MATERIALIZED (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y FROM items a JOIN items b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept
FROM sets JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) ON x = doc_id
"""
