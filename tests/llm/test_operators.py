"""The training-data operators against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from locusflow.llm import host_rules, induced, line_dedup, lsh_forest, packing, pst, queries, segments, spaced_seeds, suffix_dedup, toxicity, warc, window_index

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, source string, n_words long, kept boolean, __t string, key long"


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 4, 5, 30, 120, 300, 2000)]
    near = [" ".join(w if rng.random() > 0.01 else "zz" for w in base[5].split()) for _ in range(12)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    mixed = [" ".join(rng.choice(words) for _ in range(40)) + " " + passage + " " + " ".join(rng.choice(words) for _ in range(40)) for _ in range(5)]
    odd = [None, "", " \n\t ", "same " * 500, "x" * 900, "äöü€ " * 200, "A License Line of the Text\nother\n" * 3, "a license line of the text \nq", "A LICENSE line of the text"]
    texts = base + near + mixed + odd + [base[4], base[4], base[4].upper()]
    return list(enumerate(texts, 1))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"h{i % 3}" if i % 7 else None, None, None, "c", i) for i, t in corpus()]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_near_duplicates(spark, docs):
    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

    sets = {i: shingles(t) for i, t in corpus()}
    group = {i: i for i in sets}
    for _ in range(3):
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in lsh_forest.op3_lsh_forest(spark, docs).collect()}
    assert got == {i: (len(sets[i]), group[i], group[i] == i) for i in sets}


def test_near_duplicates_among_many_of_one_template(spark):
    def text(**changed):  # 200 shingles, a changed word takes five of them
        return " ".join(changed.get(f"s{j}", f"t{j}") for j in range(204))

    rows, want = [], {}
    for i in range(200):
        own = {f"s{j}": f"d{i}s{j}" for j in range(10, 90, 20)}  # 180 of 220 with another, 0.82
        rows.append((i, text(**own)))
        want[i] = i
        if i < 40:  # a partner: 185 of 215, 0.86
            rows.append((1000 + i, text(**own, **{f"s{j}": f"e{i}s{j}" for j in (140, 160, 180)})))
            want[1000 + i] = i
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    _, got = lsh_forest.groups(table, trees=6, least=1)
    assert {r.doc: r.component for r in got.collect()} == want


def test_windows(spark, docs):
    words = {i: (t or "").split() for i, t in corpus()}
    seen, gone = set(), {i: set() for i in words}
    for i, w in sorted(words.items()):
        for j in range(len(w) - 19):
            if (g := tuple(w[j : j + 20])) in seen:
                gone[i].update(range(j, j + 20))
            seen.add(g)
    want = {i: (len(w), len(gone[i]), sha(" ".join(x for j, x in enumerate(w) if j not in gone[i]).encode())) for i, w in words.items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in window_index.op9_window_index(spark, docs).collect()} == want


def test_window_batches(spark):
    text = " ".join(f"t{i}" for i in range(50))
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = window_index.WindowIndex(spark)
    first, second, third = make([(9, text)]), make([(1, f"new {text} end")]), make([(5, text), (6, "fresh")])
    removed = []
    for batch in (first, second, third):
        removed.append({r["__id"]: r.n_removed for r in index.strip(batch, index.repetitions(batch)).collect()})
        if batch is second:
            index.compact()
    assert removed == [{9: 0}, {1: 50}, {5: 50, 6: 0}]


def test_bytes(spark, docs):
    raw = {i: (t or "").encode() for i, t in corpus()}
    count = Counter(x[j : j + 200] for x in raw.values() for j in range(len(x) - 199))
    want = {}
    for i, x in raw.items():
        gone = bytearray(len(x))
        for j in range(len(x) - 199):
            if count[x[j : j + 200]] > 1:
                gone[j : j + 200] = b"\1" * 200
        runs = len([p for p in bytes(gone).split(b"\0") if p])
        want[i] = (len(x), sum(gone), runs, sha(bytes(b for b, g in zip(x, gone, strict=True) if not g)))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op10_suffix_dedup(spark, docs).collect()}
    assert got == want


@pytest.mark.parametrize("held", [3, 10, 1 << 20])
def test_induced_order(held):
    rng = random.Random(held)
    for _ in range(150):
        text = bytes(rng.choice(b"abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 60)))
        stored = {}
        got = list(induced.sort(text, induced.Files(stored.__setitem__, stored.__getitem__, stored.pop), most=8, held=held))
        order = sorted(range(len(text)), key=lambda i: text[i:], reverse=True)
        assert [p for p, _ in got] == order and not stored
        for (a, _), (b, common) in zip(got, got[1:], strict=False):
            assert common == next((k for k in range(8) if text[a + k : a + k + 1] != text[b + k : b + k + 1] or not text[b + k : b + k + 1]), 8)


def test_lines(spark, docs):
    lines = {i: (t or "").split("\n") for i, t in corpus()}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    holders = {}
    for i, own in lines.items():
        for x in own:
            holders.setdefault(key(x), set()).add(i)
    kept = {i: [x for x in own if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == i] for i, own in lines.items()}
    want = {i: (len(own), len(own) - len(kept[i]), sha("\n".join(kept[i]).encode())) for i, own in lines.items()}
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.op4_line_dedup(spark, docs).collect()} == want


def test_line_index_is_reversible(spark, docs):
    state = lambda x: sorted(map(tuple, x.counts.select("key", "refs", "max_doc").collect()))
    index = line_dedup.LineIndex(spark)
    index.insert(docs.where("doc_id % 2 = 0"))
    before = state(index)
    index.insert(docs.where("doc_id % 2 = 1"))
    assert state(index) != before
    index.delete(docs.where("doc_id % 2 = 1").select("doc_id"))
    assert state(index) == before


def test_rules(spark, docs):
    rows = {r.doc_id: r for r in host_rules.op6_host_rules(spark, docs).collect()}
    for i, t in corpus():
        w = (t or "").split()
        windows = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        repeated = {j + k for j in range(len(w) - 2) if windows[tuple(w[j : j + 3])] > 1 for k in range(3)}
        assert (rows[i].n_words, rows[i].n_repeat_words) == (len(w), len(repeated))
        assert rows[i].base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w)) and not (rows[i].base_failed and rows[i].kept)


def test_seeds_tolerate_substitutions(spark):
    item = [f"k{i}" for i in range(13)]
    changed = {0: item, 1: [*item[:4], "x", *item[5:9], "y", *item[10:]], 2: [w if i % 2 else "x" for i, w in enumerate(item)], 3: None}
    table = spark.createDataFrame([(i, "pre fix " + " ".join(w) + " post" if w else None) for i, w in changed.items()], "doc_id long, text string")
    found = spaced_seeds.leaks(table, spark.createDataFrame([(7, " ".join(item)), (8, None)], "item_id long, text string"))
    assert {r.doc_id for r in found.collect()} == {0, 1}


def test_packing(spark, docs):
    rows = packing.op7_packing(spark, docs).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in slots.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    encode = packing.encoder(packing.default_tokenizer())
    for i, t in corpus():
        ids = [*(encode(t).tolist() if t else []), 1]
        own = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows if r.doc_id == i)
        assert sum(x[1] for x in own) == len(ids)
        for start, length, check, total in own:
            assert total == len(ids) and check == crc32(b"".join(x.to_bytes(4, "little") for x in ids[start : start + length]))


def test_archives(spark):
    pages = spark.createDataFrame([(1, "u", "same"), (2, "u\n", "same"), (3, None, None), (4, "x", "ü" * 5000), (5, "y", "same")], "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.op1_warc(spark, pages).collect()}
    assert got == {1: (4, "revisit", 5), 2: (4, "revisit", 5), 3: (0, "response", None), 4: (10000, "response", None), 5: (4, "response", None)}


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = queries.op5_toxicity(spark, sf).where("held_out").join(labels, "doc_id").where("toxic is not null").collect()
    good, bad = [r.score for r in rows if r.toxic == 0], [r.score for r in rows if r.toxic == 1]
    assert bad and sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good)) > 0.9


def test_suffix_tree_beats_single_tokens(spark):
    total = queries.op2_suffix_tree(spark, "/root/testdata/sf0.001").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert total.s > total.b


def test_empty_tables(spark, empty):
    for found in (lsh_forest.op3_lsh_forest(spark, empty), line_dedup.op4_line_dedup(spark, empty), host_rules.op6_host_rules(spark, empty), packing.op7_packing(spark, empty), window_index.op9_window_index(spark, empty), suffix_dedup.op10_suffix_dedup(spark, empty), pst.op2_suffix_tree(spark, empty)):
        assert found.count() == 0
    assert toxicity.op5_toxicity(spark, empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(f"n{i}" for i in range(300))
    rows = spark.createDataFrame([(None, text), (None, text), (3, text), (3, text), (4, text)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in lsh_forest.op3_lsh_forest(spark, rows).collect()), key=str)
    assert got == sorted([(None, None, False)] * 2 + [(3, 3, True)] * 2 + [(4, 3, False)], key=str)
    assert line_dedup.op4_line_dedup(spark, rows).count() == window_index.op9_window_index(spark, rows).count() == suffix_dedup.op10_suffix_dedup(spark, rows).count() == 5


def test_periodic_texts_have_a_segment_a_window():
    import numpy as np

    words = np.ones(100, np.uint64)
    _, start, count = segments.segment_bounds(words, np.ones(96, np.uint64), np.array([0, 100]), 5, 20)
    assert len(start) == 81 and (count == 1).all()
