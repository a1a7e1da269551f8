"""Folders, pushed filters, narrow scans, the committing sink, the block index and damaged files."""

import gzip
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from locusflow.plans import mark_duplicates as plan
from locusflow.sources import bgzf, blocks, columns, sam, single

HEAD = ["@HD\tVN:1.4", "@SQ\tSN:chr1\tLN:9999", "@SQ\tSN:chr2\tLN:9999", "@RG\tID:a\tLB:L1"]


def record(name, flag, pos, rname="chr1", mapq=60, qual="I" * 10, pnext=None, rnext="="):
    return "\t".join(map(str, (name, flag, rname, pos, mapq, "10M", rnext, pos if pnext is None else pnext, 0, "A" * 10, qual, "LB:Z:L1")))


def pair(name, pos, mate, **more):
    return [record(name, 99, pos, pnext=mate, **more), record(name, 147, mate, pnext=pos, **more)]


def save(path, lines, head=HEAD):
    path.write_text("\n".join([*head, *lines]) + "\n")
    return str(path)


def test_a_folder_is_one_input(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    save(folder / "1.sam", pair("a", 100, 200))
    save(folder / "2.sam", pair("b", 100, 200, qual="5" * 10), [HEAD[0], HEAD[2], HEAD[3], "@RG\tID:b\tLB:L2"])
    (folder / "3.sam.gz").write_bytes(b"".join(bgzf.blocks(iter([("\n".join([*HEAD, *pair("c", 100, 200)]) + "\n").encode()]))))
    save(folder / "_ignored", pair("d", 100, 200))
    rows = plan.marked_sam(spark, str(folder)).collect()
    assert len({r.line_no for r in rows}) == len(rows) == 6
    assert {(r.qname, r.flag) for r in rows if r.is_dup} == {(n, f) for n in "bc" for f in (99, 147)}
    assert [r.qname for r in sorted(rows, key=lambda r: r.line_no)] == list("aabbcc")
    assert sam.header(str(folder)) == [*HEAD[:1], *HEAD[1:], "@RG\tID:b\tLB:L2"]
    got = plan.run(spark, str(folder), str(tmp_path / "out")).collect()
    assert [(r.bucket, r.reads, r.duplicates) for r in got] == [("chr1", 6, 4)]
    text = gzip.decompress((tmp_path / "out" / "chr1.gz").read_bytes()).decode().splitlines()
    assert [x.split("\t")[0] for x in text if not x.startswith("@")] == list("abcabc")


def test_files_that_contradict_each_other(spark, tmp_path):
    save(tmp_path / "1.sam", pair("a", 100, 200))
    save(tmp_path / "2.sam", pair("b", 100, 200), ["@SQ\tSN:chr1\tLN:5"])
    with pytest.raises(ValueError, match="lengths"):
        sam.header(str(tmp_path))


def explained(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark, tmp_path):
    rng = random.Random(1)
    lines = [record(f"r{i}", rng.choice([0, 16, 99]), rng.randrange(1000), rng.choice(["chr1", "chr2", "*"]), rng.randrange(61)) for i in range(500)]
    path = save(tmp_path / "in.sam", lines)
    whole = sam.read_sam(spark, path, push=False, split_bytes=3000)
    pushed = sam.read_sam(spark, path, split_bytes=3000)
    for condition in ("mapq >= 30", "mapq > 30 and pos < 500", "rname = 'chr2' and flag in (0, 16)", "pos between 10 and 20", "qname like 'r1%'", "line_no <= 4000", "mapq = 17"):
        plan_text = explained(pushed.where(condition))
        assert "Filter (" not in plan_text, plan_text
        assert sorted(pushed.where(condition).collect()) == sorted(whole.where(condition).collect()) != []
    kept = pushed.where("mapq % 2 = 0 and mapq >= 30 and not rname = 'chr1'")
    assert "Filter (" in explained(kept) and sorted(kept.collect()) == sorted(whole.where("mapq % 2 = 0 and mapq >= 30 and rname <> 'chr1'").collect())


def test_a_narrow_scan_cuts_what_is_asked_for(spark, tmp_path, monkeypatch):
    lines = [*pair("a", 100, 200), record("b", 0, 7)]
    path = save(tmp_path / "in.sam", lines)
    rows = sam.read_sam(spark, path, only=("pos", "line", "tags"))
    assert rows.columns == ["pos", "line", "tags"] and [tuple(r) for r in rows.collect()] == [(100, lines[0], ["LB:Z:L1"]), (200, lines[1], ["LB:Z:L1"]), (7, lines[2], ["LB:Z:L1"])]
    cut = []
    monkeypatch.setattr(columns.Chunk, "column", lambda self, name, own=columns.Chunk.column: (cut.append(name), own(self, name))[1])
    (part,) = sam.SamReader({"path": path}, ["pos"]).partitions()
    assert [b.num_rows for b in sam.SamReader({"path": path}, ["pos"]).read(part)] == [3] and cut == ["pos"]


ODD = ["short\t4", "", "  ", "x\tnone\tchr1\t12a\t-7\t\t\t+5\t-3\tA\tI\tT:1\t\tT:2", "long\t1\tchr1\t" + "9" * 25 + "\t5000000000\r", "é\t0\tchrü\t5", "\t\t\t\t\t\t\t\t\t\t\t", "tab\t1\tc\t2\t3\tM\t=\t4\t5\tS\tQ\t"]


@pytest.mark.parametrize("split", [1, 9, 40, 1 << 20])
def test_odd_lines(spark, tmp_path, split):
    path = tmp_path / "odd.sam"
    path.write_bytes("\n".join([*HEAD, *ODD, "@not a header", "last\t16"]).encode())
    rows = sam.read_sam(spark, str(path), split_bytes=split).orderBy("line_no").collect()
    assert [(r.qname, r.flag, r.rname, r.pos, r.mapq, r.pnext, r.tlen, r.tags) for r in rows] == [
        ("short", 4, "", 0, 0, 0, 0, []), ("x", 0, "chr1", 0, -7, 5, -3, ["T:1", "", "T:2"]), ("long", 1, "chr1", 0, 0, 0, 0, []), ("é", 0, "chrü", 5, 0, 0, 0, []),
        ("tab", 1, "c", 2, 3, 4, 5, [""]), ("last", 16, "", 0, 0, 0, 0, []),
    ]
    raw = path.read_bytes()
    assert all(raw[r.line_no :].startswith(r.line.encode()) for r in rows)


def test_bytes_that_are_no_text(spark, tmp_path):
    path = tmp_path / "bad.sam"
    path.write_bytes(b"\xff\xfe\t1\tc\nok\t2\tc\n")
    assert [(r.qname, r.flag) for r in sam.read_sam(spark, str(path)).collect()] == [("��", 1), ("ok", 2)]


def marked_rows(spark, n, parts=5, buckets=("chr1", "chr2", "unmapped")):
    rows = [(buckets[i % len(buckets)], record(f"r{i}", 0, 10 * i, qual="I" * (i % 50)), 0, i % 7 == 0, 10 * i, i, f"r{i}") for i in range(n)]
    return spark.createDataFrame(rows, "bucket string, line string, flag int, is_dup boolean, pos long, line_no long, qname string").repartition(parts)


def text_of(path):
    return [x for x in gzip.decompress(Path(path).read_bytes()).decode().splitlines() if not x.startswith("@")]


@pytest.mark.parametrize("streamed", [False, True])
def test_parts_are_put_in_their_places(spark, tmp_path, monkeypatch, streamed):
    if streamed:
        monkeypatch.setattr(bgzf.pafs, "LocalFileSystem", type("Other", (), {}))
    out = tmp_path / "out"
    made = bgzf.write_buckets(marked_rows(spark, 3000), HEAD, str(out), end_block=True).collect()
    assert {(r.bucket, r.records) for r in made} == {("chr1", 1000), ("chr2", 1000), ("unmapped", 1000)} and sum(r.duplicates for r in made) == len(range(0, 3000, 7))
    assert sorted(p.name for p in out.iterdir()) == ["chr1.gz", "chr2.gz", "unmapped.gz"]
    for k, bucket in enumerate(("chr1", "chr2", "unmapped")):
        assert [x.split("\t")[0] for x in text_of(out / f"{bucket}.gz")] == [f"r{i}" for i in range(3000) if i % 3 == k]


def test_a_step_that_fails_leaves_nothing(spark, tmp_path):
    rows = marked_rows(spark, 900, 4).withColumn("line", F.when(F.col("line_no") == 700, F.raise_error(F.lit("broken"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="broken"):
        bgzf.write_buckets(rows, HEAD, str(tmp_path / "out"))
    assert list((tmp_path / "out").iterdir()) == []


def test_empty_output(spark, tmp_path):
    assert bgzf.write_buckets(marked_rows(spark, 9).where("false"), HEAD, str(tmp_path / "out")).count() == 0
    assert list((tmp_path / "out").iterdir()) == []


def test_a_region_opens_its_blocks_only(spark, tmp_path, monkeypatch):
    out = tmp_path / "out"
    bgzf.write_buckets(marked_rows(spark, 60_000, 3, ("chr1",)), HEAD, str(out), index=True)
    path = str(out / "chr1.gz")
    whole = sam.read_sam(spark, path, push=False)
    for condition in ("pos between 15000 and 15300", "pos = 20010", "pos < 50", "pos >= 599950", "pos > 10 and pos < 12", "pos > 999999"):
        for split in (40_000, 1 << 20):
            got = sam.read_sam(spark, path, split_bytes=split).where(condition).orderBy("line_no").collect()
            assert got == whole.where(condition).orderBy("line_no").collect()
    opened = []
    monkeypatch.setattr(blocks, "zlib", type("Counted", (), {"error": blocks.zlib.error, "decompress": staticmethod(lambda *a, own=blocks.zlib.decompress: (opened.append(1), own(*a))[1])}))
    reader = sam.PushingReader({"path": path}, ["pos"])
    list(reader.pushFilters([sam_filter("GreaterThanOrEqual", 15000), sam_filter("LessThanOrEqual", 15300)]))
    found = [p for part in reader.partitions() for b in reader.read(part) for p in b["pos"].to_pylist()]
    assert found == list(range(15000, 15301, 10))
    assert 0 < len(opened) < 12 < len(list(blocks.inflated(sam.located(path)[0].open_input_file(path), 0))) / 5


def sam_filter(kind, value):
    from pyspark.sql import datasource

    return getattr(datasource, kind)(("pos",), value)


def test_seek_and_end(tmp_path, spark):
    text = "".join(record(f"r{i}", 0, i) + "\n" for i in range(4000)).encode()
    path = tmp_path / "a.sam.gz"
    path.write_bytes(b"".join(bgzf.blocks(iter([text]))) + bgzf.END)
    where, at = sam.located(str(path))
    with where.open_input_file(at) as file:
        assert blocks.ended(file)
        numbered = list(blocks.lines(file, 0, file.size()))
        for no, line in (numbered[0], numbered[1234], numbered[-1]):
            assert b"".join(blocks.seek(file, no)).split(b"\n")[0] == line
    assert sam.read_sam(spark, str(path), check_end=True).count() == 4000
    path.write_bytes(path.read_bytes()[:-28])
    with pytest.raises(Exception, match="marks its end"):
        sam.read_sam(spark, str(path), check_end=True).count()
    assert sam.read_sam(spark, str(path)).count() == 4000
    path.write_bytes(path.read_bytes()[:-40])
    with pytest.raises(Exception, match="cut off"):
        sam.read_sam(spark, str(path)).count()


def test_metrics_of_the_pass_that_writes(spark, tmp_path):
    rng = random.Random(2)
    lines = [x for i in range(200) for x in pair(f"q:{rng.randrange(40)}:{i % 40}", rng.randrange(90, 100), 200)]
    lines = [x.replace("q:", f"q{i // 2}:", 1) for i, x in enumerate(lines)]
    path = save(tmp_path / "in.sam", lines)
    got = {tuple(r) for r in plan.run(spark, path, str(tmp_path / "out"), optical_distance=3).select("bucket", "reads", "duplicates", "optical").collect()}
    rows = plan.marked_sam(spark, path)
    from locusflow.operators import marking, pairing

    assert got == {tuple(r) for r in marking.metrics(rows, marking.optical_duplicates(pairing.read_ends(rows), 3)).select("bucket", "reads", "duplicates", "optical").collect()}


def test_one_file_of_all_buckets(spark, tmp_path):
    rng = random.Random(3)
    lines = [record(f"u{i}", 77, 0, "*", rnext="*") for i in range(40)]
    for i in range(1500):
        p, q = rng.randrange(1, 3000), rng.randrange(1, 3000)
        lines += pair(f"c{i}", p, q, rname=rng.choice(["chr1", "chr2"])) if rng.random() < 0.8 else [record(f"d{i}", 97, p, pnext=q, rnext="chr2"), record(f"d{i}", 145, q, "chr2", pnext=p, rnext="chr1")]
    rng.shuffle(lines)
    path = save(tmp_path / "in.sam", lines, [*HEAD, "@SQ\tSN:chr3\tLN:5"])
    plan.run(spark, path, str(tmp_path / "out"), index=True)
    target = tmp_path / "all.sam.gz"
    head = sam.sorted_header(sam.header(path))
    for size in (5000, 1 << 26):
        n = single.single_file(spark, str(tmp_path / "out"), head, str(target), end_block=True, size=size)
        assert n == target.stat().st_size
        text = gzip.decompress(target.read_bytes()).decode().splitlines()
        got = [x.split("\t") for x in text[len(head) :]]
        assert text[: len(head)] == head and sorted((r[0], int(r[1]) & 1023) for r in got) == sorted((x.split("\t")[0], int(x.split("\t")[1])) for x in lines)
        order = [(("chr1", "chr2", "*").index(r[2]), int(r[3])) for r in got]
        assert order == sorted(order) and [r[0] for r in got if r[2] == "*"] == [x.split("\t")[0] for x in lines if x.startswith("u")]
    bucket = {x for b in ("chr1", "chr2", "discordant", "unmapped") for x in text_of(tmp_path / "out" / f"{b}.gz")}
    assert bucket == {"\t".join(r) for r in got}
    assert not [p for p in tmp_path.iterdir() if "parts" in p.name or p.name.startswith("all.sam.gz.")]
    plan.main(["-s", str(tmp_path / "again.gz"), path, str(tmp_path / "out2")])
    assert gzip.decompress((tmp_path / "again.gz").read_bytes()).decode().splitlines() == text


def test_merging_streams():
    import pyarrow as pa

    rng = random.Random(5)
    for _ in range(50):
        two = [sorted(rng.randrange(20) for _ in range(rng.randrange(30))) for _ in range(2)]
        cut = lambda own: (pa.record_batch({"pos": own[i : i + 4], "line": [str(x) for x in own[i : i + 4]]}) for i in range(0, len(own), 4))
        assert [p for b in single.merged_batches(*map(cut, two)) for p in b["pos"].to_pylist()] == sorted(two[0] + two[1])


def test_queries_through_files(spark):
    import duckdb

    from locusflow import queries

    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet'")
    for name in ("scanned_reads", "written_lines", "marked_lines", "marked_flags"):
        got = queries.QUERIES[name](spark, folder)
        columns_ = ", ".join(f'"{c}"' for c in got.columns)
        assert sorted(map(tuple, got.collect())) == sorted(db.execute(f"SELECT {columns_} FROM ({queries.ORACLE_SQL[name]})").fetchall()) != []


def test_tasks_are_logged_in_order(spark, tmp_path, caplog):
    with caplog.at_level("DEBUG", logger="locusflow.sources.bgzf"):
        bgzf.write_buckets(marked_rows(spark, 900), HEAD, str(tmp_path / "out"))
    tasks = [int(m.split()[1].rstrip(":")) for m in caplog.messages if m.startswith("task ")]
    assert tasks == sorted(tasks) and len(tasks) >= 3


def test_texts_of_the_sink_are_made_once(spark, tmp_path, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    def text(line, flag):
        made.add(1)
        return line

    monkeypatch.setattr(bgzf.R, "duplicate_line", F.udf(text, "string"))
    rows = marked_rows(spark, 900)
    assert bgzf.write_buckets(rows, HEAD, str(tmp_path / "out")).groupBy().sum("records").first()[0] == 900
    assert made.value <= 900  # not again as bounds are sampled


def test_duplicate_lines_need_no_pattern(spark):
    lines = ["q\t1\tchr1\tx", "q\t1", "q", "", "\t\t", "é\t16\tü\t\n\tz", "a\nb\t5\n", None]
    text = bgzf.R.duplicate_line(F.col("line"), F.lit(3))
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").select("i", text.alias("t")).orderBy("i")
    assert [r.t for r in got.collect()] == ["q\t1027\tchr1\tx", "q\t1027", "q\t1027", "\t1027", "\t1027\t", "é\t1027\tü\t\n\tz", "a\nb\t1027", None]
    assert "regexp" not in got._jdf.queryExecution().optimizedPlan().toString()
