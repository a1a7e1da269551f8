"""The similarity join by multi-match prefixes, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from locusflow.llm import lsh_forest
from locusflow.llm import prefix_join as p
from locusflow.llm import shared

COLUMNS = "doc_id long, text string, doc long, node long, k int, component long, at string"


def shingles(text, width=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}


def brute(rows, percent=90):
    own = {i: shingles(t) for i, t in rows}
    group = {i: i for i in own}
    links = [(a, b) for a in own for b in own if a < b and own[a] and own[b] and 100 * len(own[a] & own[b]) >= percent * len(own[a] | own[b])]
    while any(group[a] != group[b] for a, b in links):
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    return {i: (len(own[i]), group[i]) for i in own}


def edited(rng, words, text, n):
    out = list(text)
    for _ in range(n):
        out[rng.randrange(len(out))] = rng.choice(words)
    return out


def rows_of(groups, copies, seed=3, length=90):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(length)]
        rows += [" ".join(edited(rng, words, base, rng.randrange(4))) for _ in range(copies)]
    rows += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    rows += [None, "", " \n\t ", "one", "ONE", "one two", "one  Two", "same " * 400, "same " * 90, " ".join(words * 40), " ".join([*words * 40, "x"]), rows[0], rows[0].upper(), rows[1]]
    rng.shuffle(rows)
    return list(enumerate(rows, 1))


def table(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, "a") for i, t in rows], COLUMNS).repartition(parts)


def found(frame):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in frame.collect()}


def test_groups(spark):
    rows = rows_of(12, 8)
    assert found(p.op12_prefix_join(spark, table(spark, rows))) == brute(rows)


@pytest.mark.parametrize("crowd", [512, 16])
def test_one_crowded_group(spark, monkeypatch, crowd):
    monkeypatch.setattr(lsh_forest, "CROWD", crowd)
    monkeypatch.setattr(p, "CROWD", crowd)
    monkeypatch.setattr(p, "FEW", 6)
    rows = rows_of(1, 150, 5) + [(i + 1000, t) for i, t in rows_of(2, 3, 6)]
    assert found(p.op12_prefix_join(spark, table(spark, rows, 9))) == brute(rows)


def test_other_similarity_and_width(spark):
    rows = rows_of(8, 6, 9)
    made, members = p.groups(table(spark, rows), width=2, percent=70)
    own = {i: shingles(t, 2) for i, t in rows}
    group = {i: i for i in own}
    links = [(a, b) for a in own for b in own if a < b and own[a] and own[b] and 10 * len(own[a] & own[b]) >= 7 * len(own[a] | own[b])]
    while any(group[a] != group[b] for a, b in links):
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    assert {r.doc: r.component for r in members.collect()} == {i: group[i] for i in own if own[i]} and made.count() == len(rows)


def test_null_and_repeated_ids_and_empty_tables(spark):
    text = "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3
    rows = [(None, text), (7, text), (7, text), (9, text), (8, "other words in a text of its own"), (8, text), (3, "")]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in p.op12_prefix_join(spark, table(spark, rows)).collect())
    assert got == [(0, 26, 0), (3, 0, 3), (7, 26, 7), (7, 26, 7), (8, 6, 7), (8, 26, 7), (9, 26, 7)]
    assert p.op12_prefix_join(spark, table(spark, [])).count() == 0


def test_texts_come_in_small_batches(spark, monkeypatch):
    key, seen, write = "spark.sql.execution.arrow.maxBytesPerBatch", {}, shared.written
    before = spark.conf.get(key)

    def noted(df, label):
        seen.setdefault(label, set()).add(spark.conf.get(key))
        return write(df, label)

    def counted(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    monkeypatch.setattr(shared, "written", noted)
    rows = rows_of(1, 4)
    assert found(p.op12_prefix_join(spark, table(spark, rows))) == brute(rows)
    assert all(seen[label] == {str(4 << 20)} for label in ("sets", "prefixes", "links")) and spark.conf.get(key) == before
    with shared.batches_of(spark, 4 << 20):
        sizes = spark.range(0, 9000, 1, 1).selectExpr("repeat('x', 2000) as t").mapInArrow(counted, "n long").collect()
    assert sum(r.n for r in sizes) == 9000 and max(r.n for r in sizes) < 2500


def test_frequent_elements_lengthen_the_prefix():
    assert p.chosen(200, np.zeros(200), 90) == 1 and p.chosen(1, np.full(1, 9.0), 90) == 1
    few, many = (p.chosen(200, np.full(200, float(n)), 90) for n in (0.01, 1000))
    assert 1 <= few < many <= 180


def test_prefixes_share_enough(spark):
    """Sets that link share the smaller k of both in their prefixes, however different these are."""
    rows = [r for r in rows_of(10, 6, 2) if r[1]]
    docs = table(spark, rows).selectExpr("doc_id as doc", "text as __text")
    grams = next(p.sets(pa.array([t for _, t in rows], pa.string()), 3))[2]
    codes = np.round(np.log2(np.bincount((grams >> np.uint64(48)).astype(np.int64), minlength=1 << 16) + 1) * 6).astype(np.uint8)
    sent = spark.sparkContext.broadcast(codes)
    own = {}
    for r in p.prefixes(docs, sent, 16, 3, 90).collect():
        own.setdefault(r.doc, (r.k, set()))[1].add(r.region)
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in own for b in own if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    assert len(links) > 50 and len({k for k, _ in own.values()}) > 2
    assert all(len(own[a][1] & own[b][1]) >= min(own[a][0], own[b][0]) for a, b in links)


def test_bitmaps_never_exceed_the_difference():
    rows = rows_of(3, 6, 4)
    _, _, grams, first = next(p.sets(pa.array([t for _, t in rows], pa.string()), 3))
    maps = p.bitmaps(grams, first)
    for a in range(len(rows)):
        for b in range(a):
            one, two = set(grams[first[a] : first[a + 1]].tolist()), set(grams[first[b] : first[b + 1]].tolist())
            assert np.bitwise_count(maps[a] ^ maps[b]).sum() <= len(one ^ two)
