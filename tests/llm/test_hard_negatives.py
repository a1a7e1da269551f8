"""Dual-tree search for hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusflow.llm import hard_negatives as h

COLUMNS = "vec_id long, embedding array<double>, label int, id string, q string, cell int, rank int"


def brute(rows, positives=5, negatives=10):
    own = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        new = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v])
        own[i] = min(own.get(i, new), new)
    out = set()
    for a, (label, v) in own.items():
        if a % 100:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, m == label) for i, (m, w) in own.items() if i != a)
        for s, p, _ in [x for x in scores if x[2]][:positives]:
            fit = [x for x in scores if not x[2] and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out |= {(a, p, r, n, -s, -t) for r, (t, n, _) in enumerate(fit, 1)}
    return out


def rows_of(n, seed=3):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(9)]
    rows = []
    for i in range(n):
        m = middles[min(rng.randrange(14), 8)]
        rows.append((i, [x + rng.gauss(0, 0.05) for x in m], rng.randrange(4)))
    rows += [(n + i, [0.5, 0.25], 1 + i % 2) for i in range(60)]  # one vector, ties
    rows += [(5000, None, 1), (5100, [1.0, None], 1), (5200, [float("nan")], 1), (5300, [1.0], None), (None, [1.0], 2), (5400, [], 3), (5500, [float("inf")], 2)]
    return [*rows, rows[0], (200, [9.0] * 6, 0), (200, [9.0] * 6, 0)]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], COLUMNS).repartition(3)


def found(frame):
    return {tuple(r) for r in frame.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()}


def test_small_trees(spark, monkeypatch):
    for name, value in (("BLOCK", 40), ("GROUP", 4), ("LEAF", 6), ("SEGMENT", 3), ("CELL_ROWS", 50), ("SAMPLE", 100)):
        monkeypatch.setattr(h, name, value)
    rows = rows_of(900)
    assert found(h.op11_dual_tree(spark, table(spark, rows))) == brute(rows) != set()


def test_production_trees(spark):
    rows = rows_of(400, 8)
    assert found(h.op11_dual_tree(spark, table(spark, rows))) == brute(rows) != set()


def test_whole_cells_and_blocks_are_skipped(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(h.Forest, "run", lambda self, groups, search, schema, run=h.Forest.run: (asked.append((self.pairs(groups).count(), groups.count() * self.blocks.count())), run(self, groups, search, schema))[1])
    for name, value in (("BLOCK", 40), ("GROUP", 1), ("CELL_ROWS", 50)):
        monkeypatch.setattr(h, name, value)
    rows = rows_of(900)
    assert found(h.op11_dual_tree(spark, table(spark, rows))) == brute(rows)
    assert len(asked) == 2 and all(0 < some < 0.7 * whole for some, whole in asked), asked


def test_empty_and_too_large(spark):
    assert h.op11_dual_tree(spark, table(spark, [])).count() == 0
    assert h.op11_dual_tree(spark, table(spark, [(100, [1.0], 1)])).count() == 0
    with pytest.raises(Exception, match="31 bits"):
        h.mine(table(spark, [(1, [1e300], 1)]), F.col("id") == 1).count()


def test_products_beyond_doubles():
    a = np.array([[2.0**30 + 1, 1.0]])
    assert h.products(a, a)[0, 0] == (2**30 + 1) ** 2 + 1


@pytest.mark.parametrize("seed", [1, 2])
def test_intervals_hold_all_products(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(50, 8)) * 99, rng.normal(3, 1, (70, 8)) * 50
    (c, r), (d, s) = h.ball(a), h.ball(b)
    lo, hi = h.bounds(c[None], np.array([r]), d[None], np.array([s]))
    assert lo[0, 0] <= (a @ b.T).min() and (a @ b.T).max() <= hi[0, 0]
