"""SAM in, marked and sorted block-gzipped SAM out; also the command line.

``python -m locusflow.plans.mark_duplicates [options] INPUT OUTPUT_FOLDER``
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import marking
from ..operators.once import once
from ..operators.pairing import missing_mates, read_ends, repeated_ends
from ..operators.routing import route, with_bucket
from ..sources import bgzf, sam
from ..sources.single import single_file

log = logging.getLogger(__name__)
LEVELS = (logging.CRITICAL + 10, logging.CRITICAL, logging.ERROR, logging.WARNING, logging.INFO, logging.DEBUG, logging.DEBUG - 5)


def _unrepeated(reads: DataFrame) -> None:
    if (twice := repeated_ends(reads).first()) is not None:
        raise ValueError(f"an end stands more than once: {twice.asDict()}")


def marked_sam(spark: SparkSession, path: str, *, min_mapq: int = 0, strict: bool = False, discordant_score: str = "both") -> DataFrame:
    """All records of a SAM file or folder, all columns, with bucket, is_dup and flag_out; strict raises where an end stands twice in a bucket."""
    head = sam.header(path)
    reads = route(sam.read_sam(spark, path, min_mapq=min_mapq), sam.references(head), sam.libraries(head), min_mapq=min_mapq)
    if strict:
        _unrepeated(reads)
    return marking.with_marked_flag(marking.marked(reads, discordant_score=discordant_score))


#: What the two scans of a run cut from a record: all that marking needs, and the text with what routes it.
MARKING = ("line_no", "qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "qual", "tags")
WRITING = ("line_no", "line", "qname", "flag", "rname", "pos", "mapq", "rnext")


def run(spark: SparkSession, path: str, folder: str, *, level: int = 3, min_mapq: int = 0, optical_distance: int = 0, by_name: bool = False, strict: bool = False, end_block: bool = False, index: bool = False, single: str | None = None) -> DataFrame:
    """Mark, sort and write; returns metrics by bucket, counted by the pass that writes.

    by_name sorts by name key instead.  single names a file for all records in
    coordinate order, merged from the buckets by their index.
    """
    if single and by_name:
        raise ValueError("a single file is in the order of coordinates")
    head = sam.header(path)
    names = sam.references(head)
    narrow = route(sam.read_sam(spark, path, only=MARKING, min_mapq=min_mapq), names, sam.libraries(head), min_mapq=min_mapq)
    narrow = once(narrow.select(*marking.NARROW))
    if strict:
        _unrepeated(narrow)
    records = with_bucket(sam.read_sam(spark, path, only=WRITING, min_mapq=min_mapq), names, min_mapq=min_mapq)
    seen = Observation("written")
    rows = marking.with_marks(records, marking.losers(narrow)).observe(seen, F.count(F.lit(1)).alias("reads"), F.count_if("is_dup").alias("duplicates"))
    out = sam.sorted_header(head, "queryname" if by_name else "coordinate")
    made = bgzf.write_buckets(rows, out, folder, level=level, by_name=by_name, end_block=end_block, index=index or bool(single))
    if single:
        single_file(spark, folder, out, single, level=level, end_block=end_block)
    log.info("records read for the sink, and duplicates: %s", seen.get)
    optical = marking.optical_duplicates(read_ends(narrow), optical_distance) if optical_distance > 0 else None
    lost = missing_mates(narrow).count()
    if lost:
        log.warning("%d paired records lack their mate", lost)
    return marking.with_optical(made.select("bucket", F.col("records").alias("reads"), "duplicates"), optical)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("input")
    p.add_argument("folder")
    p.add_argument("-c", "--compression", type=int, default=3)
    p.add_argument("-n", "--by-name", action="store_true")
    p.add_argument("-q", "--min-mapq", type=int, default=0)
    p.add_argument("-d", "--optical-distance", type=int, default=0)
    p.add_argument("-s", "--single", metavar="FILE")
    p.add_argument("-i", "--index", action="store_true")
    p.add_argument("-v", "--verbosity", type=int, default=3, choices=range(len(LEVELS)))
    a = p.parse_args(argv)
    logging.basicConfig(level=LEVELS[a.verbosity])
    spark = SparkSession.builder.getOrCreate()
    run(spark, a.input, a.folder, level=a.compression, min_mapq=a.min_mapq, optical_distance=a.optical_distance, by_name=a.by_name, index=a.index, single=a.single).show(1000, False)


if __name__ == "__main__":
    main()
