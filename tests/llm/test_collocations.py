"""Phrases by exact counts, against brute force; the perfect hash and the summed arrays."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from locusflow.llm import collocations as c
from locusflow.llm import counting, shared

COLUMNS = "doc_id long, text string, lang string, phrase string, a long, f long, block int, n string"


def brute(rows, least=10, within=50, most=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    f = Counter({(k[0], k[1:]): v for k, v in f.items()})
    rows = []
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            longer = [v for (m, q), v in f.items() if m == lang and len(q) == 3 and len(p) == 2 and v >= least and p in (q[:2], q[1:])]
            if not any(100 * v >= within * a for v in longer):
                rows.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    out, rank = set(), Counter()
    for lang, score, a, p, left, right, total in sorted(rows):
        rank[lang] += 1
        if rank[lang] <= most:
            out.add((lang, rank[lang], p.decode(), -a, left, right, total, -score))
    return out


def rows_of(n=700, seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["Über", "é", "\x00x", "a b"]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", " the The "]) for _ in range(rng.randrange(40)))
        rows.append((text, rng.choice(["en", "de", None, "und", ""])))
    return rows + [(None, "en"), ("", None), ("...", "de"), ("same same " * 3000, "fr"), (rows[0][0], rows[0][1])] + [("one two three", "en")] * 12 + [("one two", "en")] * 9


def table(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, lang, "p", 1, 2, 3, "n") for i, (t, lang) in enumerate(rows)], COLUMNS).repartition(parts)


def found(frame):
    return {tuple(r) for r in frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


def test_phrases(spark):
    rows = rows_of()
    want = brute(rows)
    assert found(c.op13_collocations(spark, table(spark, rows))) == want and len(want) > 150


def test_several_tables_in_rounds_and_a_short_list(spark, monkeypatch):
    monkeypatch.setattr(c, "SLOTS", 100)
    monkeypatch.setattr(c, "ROUND", 2)
    monkeypatch.setattr(c, "NOTED", 50)
    rows = rows_of(300, 4)
    assert found(c.collocations(table(spark, rows, 40), most=20)) == brute(rows, most=20)


def test_contained_phrases_go(spark):
    phrases = {r[2] for r in found(c.collocations(table(spark, [("one two three", "en")] * 12 + [("one two", "en")] * 12 + [("one two", "en")]), least=10))}
    assert phrases == {"one two", "one two three"}  # 12 of 25 is less than half; "two three" is always inside
    assert "one two" not in {r[2] for r in found(c.collocations(table(spark, [("one two three", "en")] * 12 + [("one two", "en")] * 12)))}


def test_counts_beyond_64_bits(spark, monkeypatch):
    totals = spark.createDataFrame([("en", 9 * 10**18)], "lang string, n long")
    a, left, right = 4 * 10**12, 7 * 10**12 + 1, 9 * 10**12
    counts = spark.createDataFrame([("en", "x y", 2, a, left, right, 0, 0)], "lang string, phrase string, words long, a long, head long, tail long, first_pair long, last_pair long")
    monkeypatch.setattr(c, "counted", lambda *_, **__: (totals, counts))
    assert [r.score for r in c.collocations(counts).collect()] == [10**6 * a * a // (left * right)]


def test_empty(spark):
    assert c.op13_collocations(spark, table(spark, [])).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 1000, 50_000):
        a, b = rng.integers(0, 1 << 63, (2, n)).astype(np.uint64)
        a[: n // 2] = a[0] if n else 0  # half of the keys differ in the second part alone
        b[:n] = np.arange(n)
        slots = counting.Slots.of(a, b)
        assert sorted(slots(a, b).tolist()) == list(range(n))
        assert (slots(a ^ np.uint64(1), b) == -1).all() and (slots(a, b + np.uint64(n + 1)) == -1).all()


def test_tree_sum(spark):
    rng = random.Random(3)
    want, rows = Counter(), []
    for mapper in range(1100):
        values = np.array(sorted(rng.randrange(1 << 12) for _ in range(20)))
        want.update(values.tolist())
        rows += counting.by_block(values, 10, mapper)
    sums = counting.tree_sum(spark.createDataFrame(rows, counting.PART).repartition(4)).collect()
    got = {(r.block << 10) + at: n for r in sums for at, n in zip(*(x.tolist() for x in counting.unpacked(r.at, r.n)), strict=True)}
    assert got == want and len(sums) == len({r.block for r in sums}) and {r.mapper for r in sums} == {0}


def test_equal_keys_are_refused():
    with pytest.raises(ValueError, match="differ"):
        counting.Slots.of(np.array([5, 5], np.uint64), np.array([7, 7], np.uint64))


def test_word_keys_tell_words_apart():
    words = {bytes(x) for n in range(1, 6) for x in np.ndindex(*[2] * n)}  # zero bytes and lengths
    words |= {bytes([98 + d for d in range(7, -1, -1)][:8] + [97] * n) for n in range(12)} | {b"ab" * n for n in range(1, 30)} | {b"a" * n for n in range(1, 40)}
    words |= {b"b" + bytes(range(n, n + 12)) for n in range(90)} | {bytes(range(100 + n, 100, -1)) for n in range(1, 20)}
    words = sorted(words)
    size = np.array([len(w) for w in words])
    starts = np.concatenate(([0], np.cumsum(size)))[:-1]
    a, b = c.word_keys(np.frombuffer(b"".join(words), np.uint8), starts, starts + size)
    assert len(set(a.tolist())) == len(set(b.tolist())) == len(words)


def test_texts_are_read_three_times_however_many_tables(spark, monkeypatch):
    reads = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            reads.add(len(batch))
            yield batch

    monkeypatch.setattr(c, "LISTED", 40)
    monkeypatch.setattr(c, "PART_BYTES", 500)
    monkeypatch.setattr(c, "SLOTS", 20)
    monkeypatch.setattr(c, "ROUND", 1)
    rows = rows_of(200, 5)
    docs = table(spark, rows, 7).select("text", "lang").mapInArrow(passed, "text string, lang string")
    assert found(c.collocations(docs)) == brute(rows)
    assert 0 < reads.value <= 4 * len(rows)  # the lengths, and three passes


def test_noted_places_are_sent_a_block_at_a_time(monkeypatch):
    monkeypatch.setattr(c, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 3)}))}))
    places = np.random.default_rng(4).integers(0, 1 << 25, 1 << 20)
    noted = c.Noted(25)
    assert not list(noted.add(places))
    tracemalloc.start()
    got, most = Counter(), 0
    for batch in noted.sent():
        (row,) = batch.to_pylist()
        at, n = counting.unpacked(row["at"], row["n"])
        got.update(dict(zip(((row["block"] << c.BLOCK_BITS) + at).tolist(), n.tolist(), strict=True)) if row["block"] == 7 else {})
        most = max(most, row["block"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == Counter(places[places >> c.BLOCK_BITS == 7].tolist()) and most == 31
    assert peak < 4 * 4 * len(places)  # the places are held in 4 bytes each


def test_batches_are_small_inside_alone(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen = spark.conf.get(key), []
    docs = table(spark, [("word " * 2000, "en")] * 1000, 1)
    rows = lambda: docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [len(b)]}) for b in batches), "n long")
    with shared.batches_of(spark, c.BATCH):
        seen = [r.n for r in rows().collect()]
    assert sum(seen) == 1000 and max(seen) < 1000 and spark.conf.get(key) == before
