"""Mates: pairs of records with one name in one bucket, and what lacks a mate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import records as R
from ..schema import DISCORDANT

_END = ("pos", "line_no", "flag", "ref_idx", "mate_idx", "u", "score", "lb", "rev", "mrev", "qname")


def repeated_ends(reads: DataFrame) -> DataFrame:
    """(bucket, qname, end, n): ends that stand more than once, which well-formed input doesn't have."""
    return reads.where("eligible and paired").groupBy("bucket", "qname", "end").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def mates(reads: DataFrame) -> DataFrame:
    """(bucket, qname, a, b): both ends as structs, a the earlier by (pos, line_no).

    One aggregation by name with map-side combination, no self-join.  Of an end
    that is repeated the first record counts; a single end gives no row.
    """
    own = F.struct(*_END)
    # Names first: they tell rows apart, and sorts compare the first key's prefix.
    ends = reads.where("eligible and paired").groupBy("qname", "bucket").agg(F.min(F.when(F.col("end") == 1, own)).alias("e1"), F.min(F.when(F.col("end") == 2, own)).alias("e2"))
    return ends.where("e1 is not null and e2 is not null").select("bucket", "qname", F.least("e1", "e2").alias("a"), F.greatest("e1", "e2").alias("b"))


def missing_mates(reads: DataFrame) -> DataFrame:
    """Eligible paired records whose other end isn't in their bucket."""
    sides = reads.where("eligible and paired").groupBy("bucket", "qname").agg(F.min("end").alias("low"), F.max("end").alias("high"), F.min("line_no").alias("line_no"))
    return sides.where("low = high").select("bucket", "qname", "line_no")


def external_mates(reads: DataFrame) -> DataFrame:
    """(bucket, paired, external): eligible paired records, and those of them whose mate lies elsewhere."""
    sides = reads.where("eligible and paired").groupBy("bucket", "qname").agg(F.count(F.lit(1)).alias("n"), F.min("end").alias("low"), F.max("end").alias("high"))
    return sides.groupBy("bucket").agg(F.sum("n").alias("paired"), F.sum(F.when(F.col("low") == F.col("high"), F.col("n")).otherwise(0)).cast("long").alias("external"))


def read_ends(reads: DataFrame, *, discordant_score: str = "both") -> DataFrame:
    """A row for each pair: its representative, the key of its cluster and its score.

    On one chromosome the end with the smaller unclipped position represents
    the pair (the earlier one if equal, then with orientation FR); discordant
    pairs are always represented by the earlier end.  discordant_score "rep"
    ranks those by the representative's score alone.
    """
    return ends_of(mates(reads), discordant_score=discordant_score)


def ends_of(p: DataFrame, *more: str, discordant_score: str = "both") -> DataFrame:
    """The same for pairs (bucket, qname, a, b) that are known, with more of their columns."""
    apart = F.col("bucket") == DISCORDANT
    swap = ~apart & (F.col("b.u") < F.col("a.u"))
    p = p.withColumn("rep", F.when(swap, F.col("b")).otherwise(F.col("a"))).withColumn("oth", F.when(swap, F.col("a")).otherwise(F.col("b")))
    turn = F.when(F.col("a.u") == F.col("b.u"), 3).when(swap, R.pair_orientation(F.col("b.rev"), F.col("a.rev"))).otherwise(R.pair_orientation(F.col("a.rev"), F.col("a.mrev")))
    score = F.col("rep.score") + F.col("oth.score")
    if discordant_score == "rep":
        score = F.when(apart, F.col("rep.score")).otherwise(score)
    return p.select(
        "bucket", "qname", F.col("rep.lb").alias("lb"), F.col("rep.ref_idx").alias("rep_ref"), F.col("rep.u").alias("rep_u"), turn.cast("int").alias("orient"),
        F.col("oth.u").alias("mate_u"), F.col("rep.mate_idx").alias("mate_ref"), score.cast("int").alias("pair_score"),
        F.col("rep.pos").alias("rep_pos"), F.col("rep.line_no").alias("rep_line"), F.col("oth.line_no").alias("oth_line"), *more,
    )
