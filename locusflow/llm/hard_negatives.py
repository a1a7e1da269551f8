"""Hard negatives by dual-tree search for the largest inner products.

Vectors become integers, floor(scale * x) of each component as double, and a
row's score is its integer inner product with an anchor; higher scores come
first, ties by the smaller id.  An anchor's positives are its first
``positives`` other rows of the same label; its negatives for one are the first
``negatives`` rows of other labels whose score lies between two percentages of
the positive's.

Both sides are trees.  Median splits, fitted on a bounded sample of ``SAMPLE``
rows, make the cells of the top; every row is in one, every anchor also in one of
a coarser tree.  A cell's rows are dealt into blocks, a coarse cell's anchors into
groups, and either's rows into leaves by further splits, each with its centre and
radius.  For two nodes with centres c, d and radii r, s all inner products
lie within |c| s + |d| r + r s of c.d, so

1. groups of anchors skip whole cells, then blocks, then leaves of candidates,
   and leaves of anchors skip leaves of candidates, where that interval lies
   below what each of their anchors has already, or outside the windows of all;
2. what is left is scored exactly, as products of integer matrices.

The blocks of a group come in the order of their upper bounds, so that bounds
tighten; ``SEGMENT`` blocks make a task's share.  First bounds come from the
sample, whose rows are rows of the table.  Results are exact whatever the
sample: it only shapes the trees.  Where vectors are so spread that no interval
excludes anything, every anchor is scored with every row, in blocks.

Nulls: a row with a null id, label or vector, or with a null or non-finite
component, takes no part.  Vectors of unequal length count as filled up with
zeros.  Of rows that share an id the one with the least label, then vector,
counts.  An empty table, an anchor without positives and a positive without
negatives give no rows.  A component whose integer needs more than 31 bits
raises an error.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

#: Rows that shape the trees, at most.
SAMPLE = 8192
#: Cells at the top, at most, and rows wanted in one.
CELLS, CELL_ROWS = 1024, 2048
#: Rows of a block, anchors of a group, and rows of a leaf of either.
BLOCK, GROUP, LEAF = 2048, 512, 64
#: Blocks in a task's share of a group.
SEGMENT = 32
NONE = np.int64(-(1 << 62))


def quantised(vectors: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, label, q) of the rows that take part, one for each id; q holds the integers, 4 bytes each, without zeros at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["v"]
            at = np.asarray(lists.offsets)
            whole = lists.values.cast(pa.float64())
            x = np.floor(scale * whole.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64))
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(x))))
            keep = np.flatnonzero(bad[at[1:]] == bad[at[:-1]])
            fine = np.where(np.isfinite(x), x, 0)
            out = []
            for i in keep.tolist():
                own = fine[at[i] : at[i + 1]]
                if len(own) and np.abs(own).max() >= 1 << 31:
                    raise ValueError("a component is too large for 31 bits")
                out.append(np.trim_zeros(own.astype(">i4"), "b").tobytes())
            rows = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch["id"].take(rows), batch["label"].take(rows), pa.array(out, pa.binary())], ["id", "label", "q"])

    own = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    whole = own.where("id is not null and label is not null and v is not null").mapInArrow(run, "id long, label long, q binary")
    return whole.groupBy("id").agg(F.min(F.struct("label", "q")).alias("x")).select("id", "x.label", "x.q")


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of integers as doubles, filled up with zeros."""
    out = np.zeros((len(column), width))
    for i, q in enumerate(column.to_pylist()):
        own = np.frombuffer(q, ">i4")
        out[i, : len(own)] = own
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers: in doubles where these hold every sum, else in 64-bit integers."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1)
    if most < 1 << 53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def split(rows: np.ndarray, wanted: int, most: int) -> tuple[list[np.ndarray], list[tuple]]:
    """Rows dealt by median splits, until ``wanted`` rows at most are in a part or there are ``most`` parts; also the splits.

    A split is (normal, threshold, left, right); a child >= 0 is a split, ~child a part.
    """
    parts, splits = [], []
    queue = [(np.arange(len(rows)), 1, None, 0)]
    while queue:
        own, level, parent, side = queue.pop(0)
        cut = None
        if len(own) > wanted and 1 << level <= most:
            x = rows[own]
            far = x[((x - x.mean(0)) ** 2).sum(1).argmax()]
            other = x[((x - far) ** 2).sum(1).argmax()]
            normal = other - far
            along = x @ normal
            middle = np.median(along)
            if (along > middle).any():
                cut = normal, middle, along > middle
        place = len(splits) if cut else ~len(parts)
        if parent is not None:
            splits[parent][2 + side] = place
        if cut is None:
            parts.append(own)
        else:
            splits.append([cut[0], cut[1], 0, 0])
            queue += [(own[~cut[2]], level + 1, place, 0), (own[cut[2]], level + 1, place, 1)]
    return parts, splits


def cells_of(rows: np.ndarray, splits: list) -> np.ndarray:
    """The part each row falls into."""
    at = np.full(len(rows), 0 if splits else -1)
    while (inner := np.flatnonzero(at >= 0)).size:
        for s in np.unique(at[inner]):
            own = inner[at[inner] == s]
            right = rows[own] @ splits[s][0] > splits[s][1]
            at[own] = np.where(right, splits[s][3], splits[s][2])
    return ~at


def ball(rows: np.ndarray) -> tuple[np.ndarray, float]:
    centre = rows.mean(0)
    return centre, float(np.sqrt(((rows - centre) ** 2).sum(1).max()))


def bounds(c: np.ndarray, r: np.ndarray, d: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner products between balls (c, r) and (d, s), a row for each of the first; a unit of slack for rounding."""
    middle = c @ d.T
    wide = np.linalg.norm(c, axis=1)[:, None] * s[None] + np.linalg.norm(d, axis=1)[None] * r[:, None] + r[:, None] * s[None] + 1 + 1e-9 * np.abs(middle)
    return middle - wide, middle + wide


_NODE = "cell int, part int, n int, ids binary, labels binary, q binary, leaves binary, centre binary, radius double"


def _packed(rows: DataFrame, width: int) -> DataFrame:
    """One row for each cell and part, which are bounded: its rows in the order of its leaves, their bounds, and its ball."""
    kinds = {"int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    arrow = pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in _NODE.split(", "))])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        own = table.take(pa.array(np.argsort(table["id"].to_numpy(), kind="stable")))
        x = matrix(own["q"], width)
        parts, _ = split(x, LEAF, 1 << 30)
        place = np.concatenate(parts)
        centre, radius = ball(x)
        ids, labels = (own[c].to_numpy()[place].tobytes() for c in ("id", "label"))
        made = [key[0].as_py(), key[1].as_py(), len(place), ids, labels, x[place].astype("<i4").tobytes(), np.cumsum([0, *map(len, parts)]).astype(np.int32).tobytes(), centre.tobytes(), radius]
        return pa.Table.from_pylist([dict(zip(arrow.names, made, strict=True))], schema=arrow)

    return rows.select("cell", "part", "id", "label", "q").groupBy("cell", "part").applyInArrow(run, _NODE)


class Node:
    """A packed block or group in memory."""

    def __init__(self, row: dict, width: int):
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.x = np.frombuffer(row["q"], "<i4").reshape(len(self.ids), width).astype(np.float64)
        self.at = np.frombuffer(row["leaves"], np.int32)
        balls = [ball(self.x[a:b]) for a, b in zip(self.at[:-1], self.at[1:], strict=True)]
        self.centres, self.radii = np.stack([b[0] for b in balls]), np.array([b[1] for b in balls])
        self.kinds = [set(self.labels[a:b].tolist()) for a, b in zip(self.at[:-1], self.at[1:], strict=True)]


class Best:
    """The first ``most`` (score, id) of each of a number of lists, by falling score, then id."""

    def __init__(self, lists: int, most: int, least: np.ndarray):
        self.most, self.floor = most, least.copy()  # a list's floor: what a new row's score must reach
        self.of, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.lists = lists

    def add(self, of: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(of):
            return
        of, score, ids = np.concatenate((self.of, of)), np.concatenate((self.score, score)), np.concatenate((self.id, ids))
        order = np.lexsort((ids, -score, of))
        of, score, ids = of[order], score[order], ids[order]
        first = np.searchsorted(of, np.arange(self.lists))
        rank = np.arange(len(of)) - first[of]
        last = rank == self.most - 1
        self.floor[of[last]] = np.maximum(self.floor[of[last]], score[last])
        keep = rank < self.most
        self.of, self.score, self.id = of[keep], score[keep], ids[keep]


def _sorted_shares(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], dict]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            yield (row["group"], row["segment"]), row


class Search:
    """What one task does with the blocks of a share; subclasses say which rows count."""

    def __init__(self, width: int, most: int):
        self.width, self.most = width, most

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, anchors = None, None
        for key, row in _sorted_shares(batches):
            if key != share:
                if anchors is not None:
                    yield self.result(anchors)
                share, anchors = key, None
            if row["kind"] == 0:
                anchors = Node(row, self.width)
                self.begin(anchors, row)
            else:
                self.block(anchors, Node(row, self.width))
        if anchors is not None:
            yield self.result(anchors)

    def block(self, anchors: Node, rows: Node) -> None:
        lo, hi = bounds(anchors.centres, anchors.radii, rows.centres, rows.radii)
        for i, (a, b) in enumerate(zip(anchors.at[:-1], anchors.at[1:], strict=True)):
            wanted = np.flatnonzero(self.wanted(anchors, rows, i, lo[i], hi[i]))
            if len(wanted):
                own = np.concatenate([np.arange(rows.at[j], rows.at[j + 1]) for j in wanted])
                self.leaf(anchors, np.arange(a, b), rows, own, products(anchors.x[a:b], rows.x[own]))


class Positives(Search):
    """The first rows of an anchor's own label."""

    def begin(self, anchors: Node, row: dict) -> None:
        self.best = Best(len(anchors.ids), self.most, np.frombuffer(row["floor"], np.int64))
        self.own = [set(anchors.labels[a:b].tolist()) for a, b in zip(anchors.at[:-1], anchors.at[1:], strict=True)]

    def wanted(self, anchors: Node, rows: Node, i: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        floor = self.best.floor[anchors.at[i] : anchors.at[i + 1]].min()
        return (hi >= floor) & np.array([not self.own[i].isdisjoint(k) for k in rows.kinds])

    def leaf(self, anchors: Node, which: np.ndarray, rows: Node, own: np.ndarray, score: np.ndarray) -> None:
        good = (anchors.labels[which][:, None] == rows.labels[own][None]) & (anchors.ids[which][:, None] != rows.ids[own][None]) & (score >= self.best.floor[which][:, None])
        x, y = np.nonzero(good)
        self.best.add(which[x], score[x, y], rows.ids[own[y]])

    def result(self, anchors: Node) -> pa.RecordBatch:
        b = self.best
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (anchors.ids[b.of], b.id, b.score)], ["anchor_id", "positive_id", "positive_score"])


class Negatives(Search):
    """The first rows of other labels in the window of each of an anchor's positives."""

    def __init__(self, width: int, most: int, low: int, high: int):
        super().__init__(width, most)
        self.low, self.high = low, high

    def begin(self, anchors: Node, row: dict) -> None:
        place = {a: i for i, a in enumerate(anchors.ids.tolist())}
        self.of = np.array([place[a] for a in row["p_anchor"]], np.int64)
        self.id, self.score = np.array(row["p_id"], np.int64), np.array(row["p_score"], np.int64)
        # Least and greatest score that a negative may have, in exact integers.
        self.least, self.greatest = -((-self.low * self.score) // 100), (self.high * self.score) // 100
        self.best = Best(len(self.of), self.most, np.maximum(self.least, np.array(row["p_floor"], np.int64)))
        order = np.argsort(self.of, kind="stable")
        self.lists = np.split(order, np.searchsorted(self.of[order], np.arange(1, len(anchors.ids)))) if len(anchors.ids) else []
        self.own = [set(anchors.labels[a:b].tolist()) for a, b in zip(anchors.at[:-1], anchors.at[1:], strict=True)]

    def wanted(self, anchors: Node, rows: Node, i: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        own = np.concatenate(self.lists[anchors.at[i] : anchors.at[i + 1]])
        own = own[self.least[own] <= self.greatest[own]]
        if not len(own):
            return np.zeros(len(lo), bool)
        some = np.array([len(k | self.own[i]) > 1 for k in rows.kinds])
        return some & (hi >= self.best.floor[own].min()) & (lo <= self.greatest[own].max())

    def leaf(self, anchors: Node, which: np.ndarray, rows: Node, own: np.ndarray, score: np.ndarray) -> None:
        lists = np.concatenate(self.lists[which[0] : which[-1] + 1])
        lists = lists[self.least[lists] <= self.greatest[lists]]
        other = anchors.labels[which][:, None] != rows.labels[own][None]
        line = self.of[lists] - which[0]
        good = other[line] & (score[line] >= self.best.floor[lists][:, None]) & (score[line] <= self.greatest[lists][:, None])
        x, y = np.nonzero(good)
        self.best.add(lists[x], score[line[x], y], rows.ids[own[y]])

    def result(self, anchors: Node) -> pa.RecordBatch:
        b = self.best
        columns = (anchors.ids[self.of[b.of]], self.id[b.of], self.score[b.of], b.id, b.score)
        return pa.RecordBatch.from_arrays([pa.array(v) for v in columns], ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])


class Forest:
    """The candidates' cells and blocks, searched for groups of anchors."""

    def __init__(self, spark: SparkSession, blocks: DataFrame, centres: np.ndarray, width: int):
        self.blocks, self.width = blocks, width

        def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = batch["cell"].to_numpy()
                away = np.linalg.norm(_centres(batch, width) - centres[cell], axis=1) + batch["radius"].to_numpy()
                yield pa.RecordBatch.from_arrays([batch["cell"], pa.array(away)], ["cell", "radius"])

        balls = blocks.select("cell", "centre", "radius")
        known = balls.mapInArrow(reach, "cell int, radius double").groupBy("cell").agg(F.max("radius").alias("radius"), F.count(F.lit(1)).alias("n")).collect()  # CELLS rows at most
        radii = np.full(len(centres), -np.inf)
        for r in known:
            radii[r.cell] = r.radius
        self.cells = spark.sparkContext.broadcast((np.flatnonzero(np.isfinite(radii)), centres, radii))
        self.segments = max(1, -(-sum(r.n for r in known) // SEGMENT))

    def pairs(self, groups: DataFrame) -> DataFrame:
        """(group, cell, part, hi): the blocks whose interval with a group's ball meets [floor_min, most] of the group; whole cells are skipped first."""
        width, cells = self.width, self.cells

        def by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, centres, radii = cells.value
            for batch in batches:
                lo, hi = bounds(_centres(batch, width), batch["radius"].to_numpy(), centres[own], radii[own])
                x, y = np.nonzero((hi >= batch["floor_min"].to_numpy()[:, None]) & (lo <= batch["most"].to_numpy()[:, None]))
                yield pa.RecordBatch.from_arrays([batch[c].take(pa.array(x)) for c in ("group", "centre", "radius", "floor_min", "most")] + [pa.array(own[y].astype(np.int32))], ["group", "centre", "radius", "floor_min", "most", "cell"])

        def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                c, d = _centres(batch, width), _centres(batch, width, "b_centre")
                r, s = batch["radius"].to_numpy(), batch["b_radius"].to_numpy()
                middle = (c * d).sum(1)
                wide = np.linalg.norm(c, axis=1) * s + np.linalg.norm(d, axis=1) * r + r * s + 1 + 1e-9 * np.abs(middle)
                keep = pa.array(np.flatnonzero((middle + wide >= batch["floor_min"].to_numpy()) & (middle - wide <= batch["most"].to_numpy())))
                yield pa.RecordBatch.from_arrays([batch[k].take(keep) for k in ("group", "cell", "part")] + [pa.array(middle + wide).take(keep)], ["group", "cell", "part", "hi"])

        asked = groups.select("group", "centre", "radius", "floor_min", "most").mapInArrow(by_cell, "group long, centre binary, radius double, floor_min long, most long, cell int")
        balls = self.blocks.select("cell", "part", F.col("centre").alias("b_centre"), F.col("radius").alias("b_radius"))
        return asked.join(balls, "cell").mapInArrow(by_block, "group long, cell int, part int, hi double")

    def run(self, groups: DataFrame, search: Search, schema: str) -> DataFrame:
        """What the search finds for each group in each share of its blocks; the rows of a share arrive sorted, the group first."""
        spark = shared.session(groups)
        more = [c for c in groups.columns if c not in self.blocks.columns and c not in ("group", "floor_min", "most")]
        payload = ["ids", "labels", "q", "leaves"]
        wide = groups.select("group", F.explode(F.sequence(F.lit(0), F.lit(self.segments - 1))).alias("segment"), F.lit(0).alias("kind"), F.lit(np.inf).alias("hi"), *payload, *more)
        share = F.pmod(F.xxhash64("cell", "part"), F.lit(self.segments)).cast("int")
        kinds = dict(groups.dtypes)
        rows = self.pairs(groups).join(self.blocks, ["cell", "part"]).select("group", share.alias("segment"), F.lit(1).alias("kind"), "hi", *payload, *[F.lit(None).cast(kinds[c]).alias(c) for c in more])
        both = wide.unionByName(rows).repartition("group", "segment").sortWithinPartitions("group", "segment", "kind", F.desc("hi"))
        return both.mapInArrow(search.run, schema)


def _centres(batch: pa.RecordBatch, width: int, name: str = "centre") -> np.ndarray:
    return np.frombuffer(b"".join(batch[name].to_pylist()), np.float64).reshape(-1, width)


def _with_floors(groups: DataFrame, shape, width: int, most: int) -> DataFrame:
    """groups with floor: for each anchor the score that ``most`` sampled rows of its label reach; also floor_min and most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, sample, labels, ids, _ = shape.value
        for batch in batches:
            floors = []
            for row in batch.to_pylist():
                own = Node(row, width)
                score = np.where((own.labels[:, None] == labels[None]) & (own.ids[:, None] != ids[None]), products(own.x, sample), NONE)
                floors.append(np.sort(score, 1)[:, -most] if score.shape[1] >= most else np.full(len(own.ids), NONE))
            out = [pa.array([f.tobytes() for f in floors], pa.binary()), pa.array([int(f.min()) for f in floors], pa.int64()), pa.array([1 << 62] * len(floors), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*batch.schema.names, "floor", "floor_min", "most"])

    return groups.mapInArrow(run, ", ".join(f"`{k}` {t}" for k, t in groups.dtypes) + ", floor binary, floor_min long, most long")


def _with_windows(groups: DataFrame, good: DataFrame, shape, width: int, count: int, low: int, high: int) -> DataFrame:
    """groups that have positives, with these as lists, what ``count`` sampled rows in each one's window reach, and the group's window."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x, np.int64) for x in batch["ids"].to_pylist()]
            group = np.repeat(batch["group"].to_numpy(), [len(x) for x in ids])
            yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(np.concatenate([*ids, np.zeros(0, np.int64)]))], ["group", "anchor_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, sample, labels, _, _ = shape.value
        for batch in batches:
            floors, least, most = [], [], []
            for row in batch.to_pylist():
                search = Negatives(width, count, low, high)
                own = Node(row, width)
                search.begin(own, row | {"p_floor": [int(NONE)] * len(row["p_id"])})
                score = products(own.x, sample)[search.of]
                fits = (own.labels[search.of][:, None] != labels[None]) & (score >= search.least[:, None]) & (score <= search.greatest[:, None])
                floor = np.sort(np.where(fits, score, NONE), 1)[:, -count] if score.shape[1] >= count else np.full(len(score), NONE)
                floors.append(floor.tolist())
                least.append(int(np.maximum(floor, search.least).min()))
                most.append(int(search.greatest.max()))
            out = [pa.array(floors, pa.list_(pa.int64())), pa.array(least, pa.int64()), pa.array(most, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*batch.schema.names, "p_floor", "floor_min", "most"])

    member = groups.select("group", "ids").mapInArrow(anchors, "group long, anchor_id long")
    # A group has GROUP anchors, so its lists are bounded.
    lists = member.join(good, "anchor_id").groupBy("group").agg(F.sort_array(F.collect_list(F.struct("anchor_id", "positive_id", "positive_score"))).alias("p"))
    lists = lists.select("group", F.col("p.anchor_id").alias("p_anchor"), F.col("p.positive_id").alias("p_id"), F.col("p.positive_score").alias("p_score"))
    wide = groups.join(lists, "group").select(*groups.columns, "p_anchor", "p_id", "p_score")
    return wide.mapInArrow(run, ", ".join(f"`{k}` {t}" for k, t in wide.dtypes) + ", p_floor array<bigint>, floor_min long, most long")


def _first(rows: DataFrame, keys: list[str], score: str, ident: str, most: int) -> DataFrame:
    """The first rows of each list, numbered from 1 in ``rank``; a list holds ``most`` rows a share at most."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(ident))
    return rows.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= most)


def mine(
    vectors: DataFrame, anchor: Column, *, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); anchors are the rows whose id satisfies ``anchor``, a condition on column id."""
    spark = shared.session(vectors)
    rows = shared.written(quantised(vectors, id_col, label_col, vector_col, scale), "vectors")
    n, width, k = rows.agg(F.count(F.lit(1)), F.max(F.octet_length("q")), F.sum(anchor.cast("long"))).first()
    width = max(1, (width or 0) // 4)
    # The trees' shape: rows of least hash, SAMPLE at most, whatever the table's size.
    few = rows.orderBy(F.xxhash64("id")).limit(SAMPLE).toArrow()
    sample = matrix(few["q"], width)
    cells, splits = split(sample, 1, max(1, min(CELLS, -(-n // CELL_ROWS))))
    centres = np.stack([sample[c].mean(0) if len(c) else np.zeros(width) for c in cells])
    _, coarse = split(sample, 1, max(1, min(CELLS, -(-(k or 0) // GROUP))))
    shape = spark.sparkContext.broadcast((splits, centres, sample, few["label"].to_numpy(), few["id"].to_numpy(), coarse))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, group = (cells_of(matrix(batch["q"], width), shape.value[i]).astype(np.int32) for i in (0, 5))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], batch["q"], pa.array(cell), pa.array(group)], ["id", "label", "q", "cell", "group"])

    def parts(own: DataFrame, most: int) -> DataFrame:
        """own with part: a cell's rows dealt into parts of about ``most``."""
        size = own.groupBy("cell").agg(F.count(F.lit(1)).alias("m"))  # a row a cell: CELLS at most
        return own.join(F.broadcast(size), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / most)).cast("int"))

    dealt = shared.written(rows.mapInArrow(deal, "id long, label long, q binary, cell int, group int"), "dealt")
    blocks = shared.written(_packed(parts(dealt, BLOCK), width), "blocks")
    anchors = dealt.where(anchor).withColumn("cell", F.col("group"))
    groups = shared.written(_packed(parts(anchors, GROUP), width).withColumn("group", F.monotonically_increasing_id()), "groups")
    search = Forest(spark, blocks, centres, width)
    found = search.run(_with_floors(groups, shape, width, positives), Positives(width, positives), "anchor_id long, positive_id long, positive_score long")
    good = shared.written(_first(found, ["anchor_id"], "positive_score", "positive_id", positives).drop("rank"), "positives")
    asked = _with_windows(groups, good, shape, width, negatives, low, high)
    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    out = search.run(asked, Negatives(width, negatives, low, high), schema)
    out = shared.written(_first(out, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives), "negatives")
    for table in (rows, dealt, blocks, groups, good):
        shared.dropped(table)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_dual_tree(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    """The negatives of every hundredth row; of every seventh the label moves on by one first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(embeddings.select("vec_id", label.alias("label"), "embedding"), F.col("id") % 100 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id AS id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), s AS MATERIALIZED (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a, v b WHERE a.id % 100 = 0 AND a.id <> b.id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), n AS (
  SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT * FROM n WHERE rank <= 10
"""
