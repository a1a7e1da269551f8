"""The pipeline's stages: columns kept, decisions taken, copies and passages gone."""

import random
from collections import Counter

import corpus_pipeline as pipeline
from locusflow.llm import shared

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        docs = shared.written(stage(spark, docs, SF), name)
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    assert {r.doc_id for r in pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_near_copies_from_four_fifths_on(spark):
    rows = []
    for i in range(12):
        words = [f"p{i}w{j}" for j in range(204)]  # 200 shingles; a changed word takes five of them
        for copy, changed in enumerate((0, 4, 5)):  # against the first: 180 of 220, 0.818, and 175 of 225, 0.778
            rows.append((3 * i + copy, " ".join(f"{w}x{copy}" if j % 20 == 10 and j // 20 < changed else w for j, w in enumerate(words))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in pipeline.near_duplicates(spark, docs, SF).collect()) == sorted([3 * i for i in range(12)] + [3 * i + 2 for i in range(12)])


def test_planted_cases_by_brute_force(spark, tmp_path):
    rng = random.Random(17)
    fresh = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    items = [fresh(30) for _ in range(4)]
    license_line = "This line stands in many documents of the table"
    rows = [(i, " ".join(fresh(120))) for i in range(1, 21)]  # clean ones
    rows += [(30 + i, " ".join(fresh(60)) + f"\n  {license_line.upper() if i else license_line}\t\n" + " ".join(fresh(60))) for i in range(4)]
    rows += [(40 + i, rows[i][1]) for i in range(3)] + [(43, rows[8][1].upper())]  # exact copies
    for i in range(3, 6):  # near copies
        words = rows[i][1].split()
        words[50] = "other"
        rows.append((50 + i, " ".join(words)))
    leak = lambda item, *changed: " ".join([*fresh(50), *["x" if j in changed else w for j, w in enumerate(item)], *fresh(50)])
    rows += [(60, leak(items[0])), (61, leak(items[1][:14], 3, 9)), (62, leak(items[2][:10])), (None, leak(items[3])), (None, " ".join(fresh(80))), (None, rows[7][1])]
    rows += [(70, " ".join(fresh(90))), (70, " ".join(fresh(90))), (71, " ".join(fresh(49))), (72, None), (73, ""), (74, " ".join(fresh(3) * 40)), (75, " ".join(fresh(30000)))]
    rows += [(rows[6][0], rows[6][1])]  # a row twice
    spark.createDataFrame([(i, t, f"h{k % 2}" if k % 5 else None, k, "c") for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string, __id long, key string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def passes(text):
        w = (text or "").split()
        windows = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        repeated = {j + k for j in range(len(w) - 2) if windows[tuple(w[j : j + 3])] > 1 for k in range(3)}
        return len(w) >= 50 and 100 * len(repeated) <= 50 * len(w)

    def without_lines(rows):
        key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
        holders = {}
        for i, t in rows:
            for x in t.split("\n"):
                holders.setdefault(key(x), set()).add(-1 if i is None else i)
        goes = lambda i, x: len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and max(holders[key(x)]) != (-1 if i is None else i)
        return [(i, "\n".join(x for x in t.split("\n") if not goes(i, x))) for i, t in rows]

    def representatives(rows):
        def shingles(text):
            w = text.lower().split()
            return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

        own = [(i, t, shingles(t)) for i, t in rows]
        near = lambda a, b: a and b and 10 * len(a & b) >= 8 * len(a | b)
        return [(i, t) for i, t, a in own if i is None or not any(j is not None and j < i and near(a, b) for j, _, b in own)]

    def leaks(text):
        w = text.lower().split()
        for item in items:
            for k in range(len(item) - 12):
                for j in range(len(w) - 12):
                    if sum(x == y for x, y in zip(item[k : k + 13], w[j : j + 13], strict=True)) >= 11:
                        return True
        return False

    order = lambda rows: sorted(rows, key=str)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = [(i, t) for i, t in rows if passes(t)]
    for (name, stage), step in zip(pipeline.STAGES[:-1], (lambda r: r, without_lines, representatives, lambda r: [(i, t) for i, t in r if not leaks(t)]), strict=True):
        docs, want = shared.written(stage(spark, docs, str(tmp_path)), name), step(want)
        assert order((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()) == order(want), name
        assert docs.columns == ["doc_id", "text", "source", "__id", "key"]
    kept = {i for i, _ in want}
    assert {*range(1, 21), 30, 31, 32, 33, 62, 70, 75, None} == kept
    pieces = pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "doc_tokens").collect()
    assert {r.doc_id for r in pieces} == kept and Counter(r.doc_id for r in pieces if r.start == 0) == Counter(i for i, _ in want)
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)
