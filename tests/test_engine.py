"""Alignment engine: scalar values, own SAM files, SQL agreement, independence of partitions."""

import gzip
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from locusflow import queries
from locusflow.functions import records as R
from locusflow.operators import marking, pairing
from locusflow.plans import mark_duplicates as plan
from locusflow.sources import bgzf, sam

SF = "/root/testdata/sf0.001"
HEAD = ["@HD\tVN:1.4", "@SQ\tSN:chr10\tLN:9999", "@SQ\tSN:chr1\tLN:9999", "@RG\tID:a\tLB:L1", "@RG\tID:b\tLB:L2"]


def record(name, flag, pos, cigar="10M", qual="I" * 10, rname="chr1", rnext="=", pnext=None, mapq=60, lb="L1"):
    return "\t".join(map(str, (name, flag, rname, pos, mapq, cigar, rnext, pos if pnext is None else pnext, 0, "A" * 10, qual, f"LB:Z:{lb}")))


def pair(name, pos, mate, qual="I" * 10, **more):
    return [record(name, 99, pos, qual=qual, pnext=mate, **more), record(name, 147, mate, qual=qual, pnext=pos, **more)]


def marks(spark, tmp_path, lines, **options):
    path = tmp_path / "in.sam"
    path.write_text("\n".join([*HEAD, *lines]) + "\n")
    return {(r.qname, r.flag) for r in plan.marked_sam(spark, str(path), **options).where("is_dup").select("qname", "flag").collect()}


@pytest.mark.parametrize(
    ("cigar", "length", "start", "end"),
    [("4S37M2D3M3I4M1D83M14S", 130, 96, 243), ("5H3S10M2=1X", 13, 95, 112), ("10M", 10, 100, 109), ("3M2N4M", 9, 100, 108), ("*", 0, 100, 99)],
)
def test_cigar(spark, cigar, length, start, end):
    c, p = F.lit(cigar), F.lit(100)
    assert tuple(spark.range(1).select(R.reference_length(c), R.unclipped_start(p, c), R.unclipped_end(p, c)).first()) == (length, start, end)


@pytest.mark.parametrize(("qual", "score"), [("DCCCFFFFFF", 359), ("!!0!", 15), ("*", 0), ("~" * 1000, 16383), ("", 0)])
def test_quality(spark, qual, score):
    assert spark.range(1).select(R.quality_score(F.lit(qual))).first()[0] == score


@pytest.mark.parametrize(("name", "key"), [("HSQ1003:85:C0G5BACXX:1:1104:11698:100170", 1229554263568417136), ("abc", 0), ("912", 0x12)])
def test_name_key(spark, name, key):
    assert spark.range(1).select(R.name_key(F.lit(name))).first()[0] == key


def test_best_pair_wins_and_order_breaks_ties(spark, tmp_path):
    lines = [*pair("low", 100, 200, "5" * 10), *pair("top", 100, 200), *pair("also", 100, 200), *pair("far", 101, 200), *pair("lib", 100, 200, lb="L2")]
    assert marks(spark, tmp_path, lines) == {("low", 99), ("low", 147), ("also", 99), ("also", 147)}


def test_fragments_lose_to_pairs_and_clips_move_positions(spark, tmp_path):
    lines = [*pair("p", 100, 200), record("f", 73, 102, "2S8M"), record("g", 73, 300), record("h", 73, 300, qual="5" * 10), record("s", 73 | 256, 300)]
    assert marks(spark, tmp_path, lines) == {("f", 73), ("h", 73)}


def test_discordant_unmapped_and_quality(spark, tmp_path):
    def apart(name, mapq=60):
        return [record(name, 97, 100, rnext="chr10", pnext=500, mapq=mapq), record(name, 145, 500, rname="chr10", rnext="chr1", pnext=100, mapq=mapq)]

    lines = [*apart("x"), *apart("y", 0), *pair("z", 100, 200, mapq=0), record("u", 77, 0, "*", rname="*", rnext="*"), record("single", 0, 100, rnext="*")]
    assert marks(spark, tmp_path, lines) == {("y", 97), ("y", 145)}
    rows = plan.marked_sam(spark, str(tmp_path / "in.sam"), min_mapq=10).groupBy("bucket").count().collect()
    assert {r[0]: r[1] for r in rows} == {"discordant": 4, "unmapped": 2}


def test_repeated_end(spark, tmp_path):
    lines = [*pair("p", 100, 200), record("p", 99, 150)]
    assert marks(spark, tmp_path, lines) == set()
    with pytest.raises(ValueError, match="more than once"):
        marks(spark, tmp_path, lines, strict=True)


def test_optical_chain(spark, tmp_path):
    lines = [x for n, s in (("q:1000:1000", "I"), ("q:10:10", "5"), ("q:15:10", "5"), ("q:20:10", "5")) for x in pair(n, 100, 200, s * 10)]
    path = tmp_path / "o.sam"
    path.write_text("\n".join([*HEAD, *lines]) + "\n")
    found = marking.optical_duplicates(pairing.read_ends(plan.marked_sam(spark, str(path))), 5).collect()
    assert len(found) == 2 and not any(r.first_pass for r in found)


@pytest.mark.parametrize("split", [7, 100, 1 << 20])
def test_ranges_own_each_line_once(spark, tmp_path, split):
    lines = [x for i in range(20) for x in pair(f"n{i}", 100 + i, 300)]
    path = tmp_path / "r.sam"
    path.write_text("\n".join([*HEAD, *lines]))
    rows = sam.read_sam(spark, str(path), split_bytes=split).orderBy("line_no").collect()
    assert [r.line for r in rows] == lines


def test_files(spark, tmp_path):
    lines = [*pair("b", 200, 400), *pair("a", 100, 300, "5" * 10), *pair("c", 100, 300), record("u", 77, 0, "*", rname="*", rnext="*")]
    path = tmp_path / "f.sam"
    path.write_text("\n".join([*HEAD, *lines]) + "\n")
    got = {r.bucket: r.duplicates for r in plan.run(spark, str(path), str(tmp_path / "out"), end_block=True).collect()}
    assert got == {"chr1": 2, "unmapped": 0}
    text = gzip.decompress((tmp_path / "out" / "chr1.gz").read_bytes()).decode().splitlines()
    assert text[0] == "@HD\tVN:1.0\tSO:coordinate" and [x.split("\t")[:2] for x in text[5:]] == [["a", "1123"], ["c", "99"], ["b", "99"], ["a", "1171"], ["c", "147"], ["b", "147"]]
    assert sorted(p.name for p in Path(tmp_path / "out").iterdir()) == ["chr1.gz", "unmapped.gz"]


def test_blocks_stay_below_64k():
    import random

    data = random.Random(1).randbytes(300_000)
    made = list(bgzf.blocks(iter([data]), 9))
    assert all(len(b) <= 1 << 16 for b in made) and gzip.decompress(b"".join(made)) == data


def test_empty_input(spark, tmp_path):
    path = tmp_path / "e.sam"
    path.write_text("")
    assert plan.marked_sam(spark, str(path)).count() == 0


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    return connection


@pytest.mark.parametrize("name", ["marked_reads", "dup_metrics", "read_ends", "sorted_index", "dest_offsets", "optical_first_pass", "optical_dups", "compare_outputs", "external_mates", "reads_max_total", "dup_keys", "cigar_reflen", "name_sort_key", "bucket_route"])
def test_sql(spark, db, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = db.execute(queries.ORACLE_SQL[name]).df()[list(got.columns)]
    assert sorted(map(str, got.itertuples(index=False, name=None))) == sorted(map(str, want.itertuples(index=False, name=None)))


def test_partitions_do_not_matter(spark):
    def run():
        return sorted(map(tuple, queries.QUERIES["marked_reads"](spark, SF).where("is_dup").collect()))

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        results = []
        for n in (1, 7, 64):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(run())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2]


def test_record_without_cigar_keeps_its_bucket_but_no_reference(spark, tmp_path):
    path = tmp_path / "in.sam"
    path.write_text("\n".join([*HEAD, record("a", 99, 100, cigar="*", pnext=150), record("a", 147, 150, pnext=100)]) + "\n")
    rows = {r.flag: r for r in plan.marked_sam(spark, str(path)).collect()}
    assert (rows[99].bucket, rows[99].ref_idx, rows[99].u) == ("chr1", -1, 0) and (rows[147].bucket, rows[147].ref_idx) == ("chr1", 1)


def test_low_quality_on_an_unknown_reference_stays(spark, tmp_path):
    path = tmp_path / "in.sam"
    path.write_text("\n".join([*HEAD, record("a", 99, 100, rname="chrX", mapq=1), record("b", 99, 100, mapq=1)]) + "\n")
    assert [(r.qname, r.bucket) for r in plan.marked_sam(spark, str(path), min_mapq=30).collect()] == [("a", "unmapped")]


def test_scores_of_nulls_and_slices(spark):
    rows = [(None,), ("",), ("I" * 3,), ("!" * 9 + "0",), ("~" * 400,)]
    assert [r[0] for r in spark.createDataFrame(rows, "q string").coalesce(1).select(R.quality_score(F.col("q"))).collect()] == [None, 0, 120, 15, 16383]


def test_second_optical_pass_over_many_clusters(spark):
    import random

    rng = random.Random(4)
    rows = [("chr1", 0, 0, c, 2, 9, 0, rng.randrange(50), p, 100 * c + p, f"n:{rng.randrange(30)}:{rng.randrange(30)}" if rng.random() < 0.9 else "odd") for c in range(40) for p in range(rng.randint(1, 7))]
    columns = ["bucket", "lb", "rep_ref", "rep_u", "orient", "mate_u", "mate_ref", "pair_score", "rep_pos", "rep_line", "qname"]
    got = {r.rep_line for r in marking.optical_duplicates(spark.createDataFrame(rows, columns).repartition(5), 6).collect()}
    want = set()
    for c in range(40):
        own = [r for r in rows if r[3] == c]
        best = min(own, key=lambda r: (-r[7], r[8], r[9]))
        spots = [(tuple(map(int, r[10].split(":")[1:])), r is best, r[9]) for r in own if r[10] != "odd"]
        close = lambda a, b: all(abs(x - y) <= 6 for x, y in zip(a[0], b[0], strict=True))
        near = {s[2] for s in spots for w in spots if len(own) > 1 and w[1] and not s[1] and close(s, w)}
        for i, a in enumerate(spots):
            for b in spots[i + 1 :]:
                if not a[1] and not b[1] and close(a, b):
                    near.add(b[2] if a[2] in near else a[2])
        want |= near
    assert got == want


@pytest.mark.parametrize("split", [100, 700, 1 << 20])
def test_blocked_output_is_read_in_ranges(spark, tmp_path, monkeypatch, split):
    lines = [record(f"r{i}", 0, i, qual="I" * (i % 90)) for i in range(400)]
    text = ("\n".join([*HEAD, *lines]) + "\n").encode()
    path = tmp_path / "in.sam.gz"
    monkeypatch.setattr(bgzf, "BLOCK", 997)
    path.write_bytes(b"".join(bgzf.blocks(iter([text]))) + bgzf.END)
    assert sam.header(str(path)) == HEAD
    got = sam.read_sam(spark, str(path), split_bytes=split).orderBy("line_no").collect()
    assert [r.line for r in got] == lines and len({r.line_no for r in got}) == 400


def test_command_line(spark, tmp_path, capsys):
    path = tmp_path / "in.sam"
    path.write_text("\n".join([*HEAD, *pair("a", 100, 200), *pair("b", 100, 200, qual="5" * 10)]) + "\n")
    plan.main(["-q", "0", "-d", "5", str(path), str(tmp_path / "out")])
    assert "chr1" in capsys.readouterr().out
    with gzip.open(tmp_path / "out" / "chr1.gz", "rt") as file:
        assert [x.split("\t")[1] for x in file if not x.startswith("@")] == ["99", "1123", "147", "1171"]
