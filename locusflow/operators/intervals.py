"""Intervals of positions, and which of them holds a position."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .once import once

#: Intervals whose bounds go to the rows; of more, the rows go to the bounds.
SENT = 1_000_000


def position_intervals(reads: DataFrame, width: int | None = None) -> DataFrame:
    """(bucket, first_pos, last_pos): what the records of each bucket cover; with a width, of each stretch of so many positions."""
    key = ["bucket"] if width is None else ["bucket", F.floor(F.col("pos") / width).alias("stretch")]
    return reads.groupBy(*key).agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")).select("bucket", "first_pos", "last_pos")


def located(rows: DataFrame, intervals: DataFrame, position: str) -> DataFrame:
    """rows with ``inside``: whether an interval of their bucket holds the position; a null bucket or position is in none.

    Intervals (bucket, first_pos, last_pos) don't overlap.  Their sorted bounds
    are searched where they are few, by their count; else rows and bounds are
    sorted together by range, and each row sees the last bound before it.
    """
    few = intervals.limit(SENT + 1).count() <= SENT
    return _searched(rows, intervals, position) if few else _merged(rows, intervals, position)


def _searched(rows: DataFrame, intervals: DataFrame, position: str) -> DataFrame:
    bounds = defaultdict(list)
    for r in intervals.collect():  # SENT rows at most
        bounds[r.bucket].append((r.first_pos, r.last_pos))
    sorted_bounds = {b: np.array(sorted(v), np.int64).T for b, v in bounds.items()}
    sent = rows.sparkSession.sparkContext.broadcast(sorted_bounds)

    def inside(bucket: pa.Array, at: pa.Array) -> pa.Array:
        known, place = at.is_valid().to_numpy(zero_copy_only=False), at.fill_null(0).to_numpy()
        out = np.zeros(len(bucket), bool)
        for name in pc.unique(bucket).to_pylist():
            if name in sent.value:
                first, last = sent.value[name]
                own = np.flatnonzero(pc.equal(bucket, name).fill_null(False).to_numpy(zero_copy_only=False) & known)
                k = np.searchsorted(first, place[own], "right") - 1
                out[own] = (k >= 0) & (place[own] <= last[np.maximum(k, 0)])
        return pa.array(out)

    return rows.withColumn("inside", F.arrow_udf(inside, "boolean")(F.col("bucket"), F.col(position).cast("long")))


def _merged(rows: DataFrame, intervals: DataFrame, position: str) -> DataFrame:
    """The same by stretches of positions between the bounds' quantiles: every interval goes to the stretches that it meets."""
    cuts = intervals.select(F.percentile_approx("first_pos", [i / 1000 for i in range(1, 1000)], 10_000)).first()[0] or []
    ends = F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts))])
    stretch = lambda c: F.size(F.filter(ends, lambda x: x < c))
    own = once(rows.withColumn("__row", F.monotonically_increasing_id()))  # written, as numbers made again would differ
    spread = intervals.select(F.col("bucket").alias("__b"), "first_pos", "last_pos", F.explode(F.sequence(stretch(F.col("first_pos")), stretch(F.col("last_pos")))).alias("__s"))
    hit = (F.col("bucket") == F.col("__b")) & (F.col("__stretch") == F.col("__s")) & F.col(position).between(F.col("first_pos"), F.col("last_pos"))
    found = own.withColumn("__stretch", stretch(F.col(position))).join(spread, hit, "left_semi").select(F.col("__row").alias("__found"))
    out = own.join(found, F.col("__row") == F.col("__found"), "left")
    return out.withColumn("inside", F.col("__found").isNotNull()).drop("__row", "__found")


def mate_states(reads: DataFrame, intervals: DataFrame) -> DataFrame:
    """(line_no, bucket, state) of the eligible records without a mate in their bucket.

    single: not paired, or the mate isn't mapped; outside: the stated position of
    the mate lies in no interval of the bucket; absent: it lies in one, but no
    record of the other end is there.
    """
    eligible = reads.where("eligible").select("line_no", "bucket", "qname", "end", "paired", "pnext")
    single = eligible.where("not paired").select("line_no", "bucket", F.lit("single").alias("state"))
    names = eligible.where("paired").groupBy("bucket", "qname").agg(F.min("end").alias("low"), F.max("end").alias("high")).where("low = high").select("bucket", "qname")
    alone = located(eligible.where("paired").join(names, ["bucket", "qname"]), intervals, "pnext")
    return single.unionByName(alone.select("line_no", "bucket", F.when(F.col("inside"), "absent").otherwise("outside").alias("state")))
