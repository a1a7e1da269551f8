"""Derived columns and buckets: chromosome, discordant or unmapped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import records as R
from ..schema import DISCORDANT, UNMAPPED


def index_of(value: Column, names: Sequence[str], missing: int) -> Column:
    """The place of a value in a header's list, ``missing`` if it isn't there."""
    if not names:
        return F.lit(missing).cast("int")
    lookup = F.create_map(*[x for i, n in enumerate(dict.fromkeys(names)) for x in (F.lit(n), F.lit(i))])
    return F.coalesce(F.try_element_at(lookup, value), F.lit(missing)).cast("int")


def with_bucket(raw: DataFrame, references: Sequence[str], *, min_mapq: int = 0) -> DataFrame:
    """raw with bucket, without records below min_mapq on one chromosome.

    Both ends mapped to one reference: its bucket, if MAPQ is min_mapq at
    least; to two: discordant; all else: unmapped.
    """
    own, other = _places(references)
    both = (own >= 0) & (other >= 0)
    out = raw.withColumn("bucket", F.when(both & (own == other), F.col("rname")).when(both, F.lit(DISCORDANT)).otherwise(F.lit(UNMAPPED)))
    return out.where((F.col("bucket").isin(DISCORDANT, UNMAPPED)) | (F.col("mapq") >= min_mapq)) if min_mapq > 0 else out


def _places(references: Sequence[str]) -> tuple[Column, Column]:
    mate = F.when(F.col("rnext") == "=", F.col("rname")).otherwise(F.col("rnext"))
    return index_of(F.col("rname"), references, -1), index_of(mate, references, -1)


def route(raw: DataFrame, references: Sequence[str], libraries: Sequence[str] = (), *, min_mapq: int = 0) -> DataFrame:
    """raw with bucket (see with_bucket), ref_idx, mate_idx, end, rev, mrev, u, score, lb, paired, eligible.

    A missing or unknown library is the first one.  A record without CIGAR
    follows its reference into a bucket, but has no reference index and no 5'
    position.
    """
    own, other = _places(references)
    flag = F.col("flag")
    out = with_bucket(raw, references, min_mapq=min_mapq).withColumn("ref_idx", F.when(F.col("cigar") == "*", F.lit(-1)).otherwise(own)).withColumn("mate_idx", other)
    library = index_of(R.tag_value(F.col("tags"), "LB:Z:"), libraries, 0)
    return (
        out.withColumn("end", R.end_number(flag)).withColumn("rev", R.strand(flag)).withColumn("mrev", R.mate_strand(flag))
        .withColumn("u", R.unclipped_five_prime(flag, F.col("pos"), F.col("cigar"))).withColumn("score", R.quality_score(F.col("qual")))
        .withColumn("lb", library).withColumn("paired", R.is_paired(flag))
        .withColumn("eligible", R.is_primary_mapped(flag) & (F.col("bucket") != UNMAPPED))
    )
