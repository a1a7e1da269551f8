"""Prefix sums, intervals and the optical rules against plain loops; plans without a group in one task."""

import random
import time
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from locusflow import queries
from locusflow.operators import intervals, marking
from locusflow.operators.once import once
from locusflow.operators.prefix import running_sums

SF = "/root/testdata/sf0.001"


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", "b", "b", None, ""]), rng.randrange(20), i, rng.choice([None, 1, 5, -3]), 1) for i in range(3000)]
    table = spark.createDataFrame(rows, "k string, p long, i long, v long, n long").repartition(7)
    want, seen = {}, defaultdict(lambda: [0, 0])
    for k, _, i, v, n in sorted(rows, key=lambda r: (r[0] or "", r[0] is not None, r[1], r[2])):
        want[i] = tuple(seen[k])
        seen[k] = [seen[k][0] + (v or 0), seen[k][1] + n]
    got = {r.i: (r.before_v, r.before_n) for r in running_sums(table, "k", ["p", "i"], ["v", "n"]).collect()}
    assert got == want
    assert running_sums(table.where("false"), "k", ["p", "i"], ["v"]).count() == 0


def test_running_sums_have_no_window(spark):
    for name in ("sorted_index", "dest_offsets"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan


@pytest.mark.parametrize("sent", [1_000_000, 3])
def test_positions_in_intervals(spark, monkeypatch, sent):
    monkeypatch.setattr(intervals, "SENT", sent)
    rng = random.Random(2)
    bounds = [(b, p, p + rng.randrange(6)) for b in ("x", "y") for p in range(0, 400, 9)]
    rows = [(i, rng.choice(["x", "y", "z", None]), rng.choice([None, *range(-5, 420)])) for i in range(2000)]
    table, own = spark.createDataFrame(rows, "i long, bucket string, at long"), spark.createDataFrame(bounds, "bucket string, first_pos long, last_pos long")
    got = {r.i: r.inside for r in intervals.located(table.repartition(3), own, "at").collect()}
    assert got == {i: at is not None and any(b == c and lo <= at <= hi for c, lo, hi in bounds) for i, b, at in rows}
    assert {r.inside for r in intervals.located(table, own.where("false"), "at").collect()} == {False}


def test_mate_states(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    want = sorted(db.execute(f"SELECT line_no, bucket, state FROM ({queries.ORACLE_SQL['mate_states']})").fetchall())
    got = sorted(map(tuple, queries.QUERIES["mate_states"](spark, SF).select("line_no", "bucket", "state").collect()))
    assert got == want and {r[2] for r in got} == {"single", "absent", "outside"}


COLUMNS = ["bucket", "lb", "rep_ref", "rep_u", "orient", "mate_u", "mate_ref", "pair_score", "rep_pos", "rep_line", "qname"]


def in_order(spots, distance):
    """The rules as a walk in order over (place, x, y, best)."""
    close = lambda a, b: abs(a[1] - b[1]) <= distance and abs(a[2] - b[2]) <= distance
    near = {s[0] for s in spots for w in spots if w[3] and not s[3] and close(s, w)}
    for i, a in enumerate(spots):
        later = [b for b in spots[i + 1 :] if not a[3] and not b[3] and close(a, b)]
        if later and a[0] not in near:
            near.add(a[0])
            later = later[1:]
        near |= {b[0] for b in later}
    return near


@pytest.mark.parametrize(("seed", "width", "size", "distance"), [(1, 12, 9, 2), (2, 40, 30, 5), (3, 200, 60, 9), (4, 6, 40, 3), (5, 60, 12, 1)])
def test_optical_rules(spark, seed, width, size, distance):
    rng = random.Random(seed)
    rows, want = [], set()
    for c in range(60):
        spots = []
        for p in range(rng.randint(2, size)):
            x, y = rng.randrange(-3, width), rng.randrange(width if seed % 2 else 2)
            rows.append(("chr1", 0, 0, c, 2, 9, 0, 50 if p else 60, p // 2, 1000 * c + p, f"n:{x}:{y}"))
            spots.append((1000 * c + p, x, y, p == 0))
        want |= in_order(spots, distance)
    found = marking.optical_duplicates(spark.createDataFrame(rows, COLUMNS).repartition(5), distance).collect()
    assert {r.rep_line for r in found} == want and len(found) == len(want)


def test_optical_chains_of_many_steps(spark):
    rows = [("chr1", 0, 0, 1, 2, 9, 0, 5, 0, 0, "n:-900:0")] + [("chr1", 0, 0, 1, 2, 9, 0, 1, i, i, f"n:{i * 5}:0") for i in range(1, 70)]
    found = {r.rep_line for r in marking.optical_duplicates(spark.createDataFrame(rows, COLUMNS), 5).collect()}
    assert found == in_order([(i, -900 if not i else i * 5, 0, not i) for i in range(70)], 5)


def test_a_cluster_of_a_hundred_thousand(spark):
    spots = spark.range(100_000).select(
        F.lit("chr1").alias("bucket"), *[F.lit(0).alias(c) for c in COLUMNS[1:7]], F.when(F.col("id") == 0, 9).otherwise(1).alias("pair_score"), F.lit(5).cast("long").alias("rep_pos"), F.col("id").alias("rep_line"),
        F.concat(F.lit("n:"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") * 7919 % 90_001), F.lit(":"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") * 104_729 % 90_007)).alias("qname"),
    )
    start = time.perf_counter()
    found = marking.optical_duplicates(spots, 10)
    assert found.where("rep_line % 3 = 0").count() == 33_333 and time.perf_counter() - start < 120


def test_reads_take_one_window_and_one_sort(spark):
    plan = queries.reads(spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window [") == 1


def test_dense_cells_are_not_walked(spark, monkeypatch):
    walked, walk = [], marking._walk
    monkeypatch.setattr(marking, "_walk", lambda spots, distance: (walked.append(spots.count()), walk(spots, distance))[1])
    spots = [(1000 * c + p, p % 4 * 30, 0, p == 0) for c in range(20) for p in range(20)]
    rows = [("chr1", 0, 0, s[0] // 1000, 2, 9, 0, 60 if s[3] else 50, 5, s[0], f"n:{s[1]}:{s[2]}") for s in spots]
    found = marking.optical_duplicates(spark.createDataFrame(rows, COLUMNS), 10).collect()
    assert {r.rep_line for r in found} == {x for c in range(20) for x in in_order(spots[20 * c : 20 * c + 20], 10)} and walked == [0]


def test_metrics_of_clusters_are_those_of_marked_records(spark):
    narrow = marking.once(queries.reads(spark, SF).select(*marking.NARROW))
    ends = marking.read_ends(narrow)
    optical = marking.optical_duplicates(ends, 20)
    got, want = marking.metrics_of_clusters(narrow, ends, optical), marking.metrics(marking.marked(narrow, narrow=narrow), optical)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.dtypes == want.dtypes
    assert "SortMergeJoin [line_no" not in got._jdf.queryExecution().sparkPlan().toString()


def test_score_differences_join_records_once(spark):
    r = queries.reads(spark, "/root/testdata/sf0.001").select(*marking.NARROW)
    r = once(r)
    one, two = (marking.with_marked_flag(marking.marked(r, discordant_score=s, narrow=r)) for s in ("both", "rep"))
    want, found = marking.differences(one, two), queries.QUERIES["compare_outputs"](spark, "/root/testdata/sf0.001")
    assert found.dtypes == want.dtypes and sorted(found.collect()) == sorted(want.collect()) and found.count() > 0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1


def planned(monkeypatch):
    """Spark's plans of the tables that marking writes from now on."""
    plans, write = [], marking.once
    monkeypatch.setattr(marking, "once", lambda df: (plans.append(df._jdf.queryExecution().sparkPlan().toString()), write(df))[1])
    return plans


def test_metrics_send_no_spots_through_the_driver(spark, monkeypatch):
    plans = planned(monkeypatch)
    assert queries.QUERIES["dup_metrics"](spark, SF).count() == 8
    assert sum("SortMergeJoin" in p for p in plans) > 4 and not [p for p in plans if "Broadcast" in p]


def test_optical_walk_sends_no_chains_through_the_driver(spark, monkeypatch):
    plans = planned(monkeypatch)
    rows = [("chr1", 0, 0, 1, 2, 9, 0, 5, 0, 0, "n:-900:0")] + [("chr1", 0, 0, 1, 2, 9, 0, 1, i, i, f"n:{i * 5}:0") for i in range(1, 70)]
    ends = once(spark.createDataFrame(rows, COLUMNS))
    plans.append(marking.optical_duplicates(ends, 5)._jdf.queryExecution().sparkPlan().toString())
    assert len(plans) > 10 and "SortMergeJoin" in plans[-1] and not [p for p in plans if "Broadcast" in p]


def test_first_optical_pass_alone(spark, monkeypatch):
    want = sorted(map(tuple, queries._optical(spark, SF).where("first_pass").select("bucket", "rep_line").collect()))
    monkeypatch.setattr(marking, "_second_pass", None)
    found = queries.QUERIES["optical_first_pass"](spark, SF)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 10
    assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()
    assert marking.first_optical_duplicates(queries._ends(spark, SF), 0).isEmpty()
