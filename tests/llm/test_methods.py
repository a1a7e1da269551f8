"""The dealt structures of the operators against brute force, on several partitions and at their limits."""

import hashlib
import io
import json
import math
import random
from collections import Counter
from itertools import combinations
from zlib import crc32

import numpy as np
import pytest

import corpus_pipeline as pipeline
from locusflow.llm import host_rules, induced, line_dedup, lsh_forest, packing, pst, shared, spaced_seeds, suffix_dedup, textvec, toxicity, warc, window_index

TEXTS = "doc_id long, text string"


def test_hashes_of_ranges_differ_for_strings_that_agree_modulo_powers_of_two():
    one = np.array([bin(i).count("1") & 1 for i in range(4096)], np.uint8) + 97
    both = np.concatenate((one, 195 - one))
    for which in (0, 1):
        a, b = textvec.range_hashes(both, np.array([0, 4096]), np.array([4096, 8192]), which)
        assert a != b
        assert len(set(textvec.range_hashes(np.tile(one, 3), np.arange(3) * 4096, np.arange(1, 4) * 4096, which).tolist())) == 1


def test_components(spark, monkeypatch):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(None, 1), (5, 5), (7, None)]
    root = {n: n for e in edges if None not in e for n in e}
    for _ in root:
        for a, b in edges:
            if a is not None and b is not None:
                root[a] = root[b] = min(root[a], root[b])
    want = {n: r for n, r in root.items() if any(n in e and e[0] != e[1] and None not in e for e in edges)}
    table = spark.createDataFrame(edges, "a long, b long")
    for few in (1_000_000, 10):
        monkeypatch.setattr(shared, "FEW_EDGES", few)
        assert {r.node: r.component for r in shared.components(table).collect()} == want


@pytest.mark.parametrize(("partitions", "crowd"), [(1, 512), (7, 16), (51, 16)])
def test_groups_do_not_depend_on_partitions_or_crowds(spark, monkeypatch, partitions, crowd):
    monkeypatch.setattr(lsh_forest, "CROWD", crowd)
    rng = random.Random(11)
    base = [f"b{i}" for i in range(120)]
    texts = [" ".join(w if rng.random() > p else f"z{rng.randrange(9**9)}" for w in base) for p in [0.004] * 60 + [0.03] * 30] + [" ".join(f"o{j}w{i}" for i in range(40)) for j in range(20)]
    rng.shuffle(texts)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    group = list(range(len(texts)))
    links = [(a, b) for a, b in combinations(range(len(texts)), 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    for _ in texts:
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    table = spark.createDataFrame(list(enumerate(texts)), TEXTS).repartition(partitions)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        _, got = lsh_forest.groups(table)
        assert {r.doc: r.component for r in got.collect()} == dict(enumerate(group))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_square_has_fewer_links_than_components(spark):
    base = [f"b{i}" for i in range(200)]
    nodes = list(range(60))
    random.Random(3).shuffle(nodes)
    rows = [(0, 0, 0, lsh_forest.BOTH, n, n, " ".join(base[:i] + [f"z{n}"] + base[i + 1 :])) for i, n in enumerate(nodes)]  # 191 of 201 and more
    dealt = spark.createDataFrame(rows, "region long, i int, j int, kind int, node long, component long, __text string")
    links = [(r.a, r.b) for r in lsh_forest._square_links(dealt, 85).collect()]
    assert len(links) == 59
    assert {r.component for r in shared.components(spark.createDataFrame(links, "a long, b long")).collect()} == {0}


def test_links_of_a_crowd_grow_with_its_classes(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(200)]
    texts = [" ".join(w if rng.random() > p else f"z{rng.randrange(9**9)}" for w in base) for p in [0.006] * 150 + [0.02] * 50]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(196)} for t in texts]
    group = list(range(len(texts)))
    links = [(a, b) for a, b in combinations(range(len(texts)), 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    for _ in texts:
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    made, square_links = [], lsh_forest._square_links

    def counted(*given):
        found = shared.written(square_links(*given), "found")
        made.append(found.count())
        return found

    monkeypatch.setattr(lsh_forest, "CROWD", 16)
    monkeypatch.setattr(lsh_forest, "_square_links", counted)
    monkeypatch.setattr(lsh_forest, "_shrunk", lambda members, *rest: lsh_forest._alone(members))  # as if the rounds found nothing
    _, got = lsh_forest.groups(spark.createDataFrame(list(enumerate(texts)), TEXTS).repartition(4))
    assert {r.doc: r.component for r in got.collect()} == dict(enumerate(group))
    assert sum(made) < 10 * len(texts)


def repeats(batches, width):
    """Words that stay, by brute force, of batches of (id, words): earlier batches first, then ids."""
    seen, out = set(), {}
    for batch in batches:
        for i, w in sorted(batch):
            gone = set()
            for j in range(len(w) - width + 1):
                if (g := tuple(w[j : j + width])) in seen:
                    gone.update(range(j, j + width))
                seen.add(g)
            out[i] = " ".join(x for j, x in enumerate(w) if j not in gone)
    return out


@pytest.mark.parametrize("partitions", [1, 2, 7])
def test_window_batches_at_random(spark, partitions):
    rng = random.Random(partitions)
    passages = [[rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(25, 60))] for _ in range(4)]
    ids = list(range(40))
    rng.shuffle(ids)  # smaller ids come in later batches too
    rows = [(i, sum((rng.choice(passages)[rng.randint(0, 9) :] + [f"u{rng.randrange(50)}"] for _ in range(rng.randint(0, 4))), [])) for i in ids]
    batches, index, got = [rows[:12], rows[12:25], [], rows[25:]], window_index.WindowIndex(spark), {}
    for n, batch in enumerate(batches):
        table = spark.createDataFrame([(i, " ".join(w)) for i, w in batch], TEXTS).repartition(partitions)
        got |= {r["__id"]: r["__text"] for r in index.strip(table, index.repetitions(table)).collect()}
        if n == 1:
            index.compact()
            assert len(index.runs) == 1
    assert got == repeats(batches, 20)


def test_windows_of_long_words_that_agree_modulo_powers_of_two(spark):
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    tail = " ".join(f"t{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{word} {tail}"), (2, f"{word.translate(str.maketrans('ab', 'ba'))} {tail}"), (2, f"{word} {tail}")], TEXTS)
    assert sorted(r.n_removed for r in window_index.op9_window_index(spark, docs).collect()) == [0, 0, 20]


def test_a_document_inserted_again_is_a_repetition(spark):
    docs = spark.createDataFrame([(3, " ".join(f"t{i}" for i in range(30)))], TEXTS)
    index = window_index.WindowIndex(spark)
    assert [r.n_removed for _ in range(2) for r in index.strip(docs, index.repetitions(docs)).collect()] == [0, 30]


def repeated_bytes(pieces, width):
    count = Counter(p[j : j + width] for p in pieces for j in range(len(p) - width + 1))
    return [[j for j in range(len(p) - width + 1) if count[p[j : j + width]] > 1] for p in pieces]


def test_array_sort_against_plain_sort():
    rng = random.Random(4)
    for n in range(400):
        text = bytes(rng.randrange(rng.choice([1, 2, 4, 256])) for _ in range(rng.randint(1, 70))) * rng.choice([1, 1, 3])
        most = rng.choice([4, 8, 9, 30])
        order, share = induced.sort_held(np.frombuffer(text, np.uint8), most)
        plain = sorted(range(len(text)), key=lambda i: text[i:], reverse=True)
        assert sorted(order.tolist()) == list(range(len(text))) and [text[i : i + most] for i in order] == [text[i : i + most] for i in plain], n
        common = lambda a, b: next((k for k in range(most) if a + k >= len(text) or b + k >= len(text) or text[a + k] != text[b + k]), most)
        assert share.tolist() == [0, *(common(a, b) for a, b in zip(plain, plain[1:], strict=False))]


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_shards_in_memory_and_in_files(monkeypatch, limit):
    monkeypatch.setattr(suffix_dedup, "HELD_BYTES", limit)
    monkeypatch.setattr(induced, "BLOCKS", 7)
    rng = random.Random(9)
    for _ in range(25):
        base = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 80))) for _ in range(4)]
        pieces = [rng.choice(base)[rng.randint(0, 9) :] + rng.choice(base) for _ in range(rng.randint(1, 9))]
        stored = {}
        got = suffix_dedup.repeated_windows(pieces, 40, induced.Files(stored.__setitem__, stored.__getitem__, stored.pop), held=50)
        assert [x.tolist() for x in got] == repeated_bytes(pieces, 40)
        assert not stored or limit


def test_hot_keys_are_split_and_files_used(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "KEY_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "HELD_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 4000)
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(50)) + "".join(c if rng.random() > 0.01 else "Z" for c in passage) + str(i)) for i in range(60)]
    found = {r.doc_id: r.n_removed for r in suffix_dedup.op10_suffix_dedup(spark, spark.createDataFrame(rows, TEXTS).repartition(5)).collect()}
    own = repeated_bytes([t.encode() for _, t in rows], 200)
    assert found == {i: len({p for s in x for p in range(s, s + 200)}) for (i, _), x in zip(rows, own, strict=True)} and any(found.values())


class Counted(io.BytesIO):
    read_bytes = 0

    def read(self, n=-1):
        data = super().read(n)
        Counted.read_bytes += len(data)
        return data


def test_archive_ranges_own_each_record_once_and_read_little():
    rng = random.Random(1)
    members = [warc.member(warc.record(i, "u", rng.randbytes(300_000 if i % 50 == 3 else rng.randint(0, 400)), "X", None, False)) for i in range(200)]
    blob, places = b"".join(members), [sum(map(len, members[:i])) for i in range(200)]
    for split in (97, 5000, 1 << 20, 32 << 20):
        Counted.read_bytes = 0
        assert [at for s in range(0, len(blob), split) for at, _, _ in warc.scan(Counted(blob), s, min(s + split, len(blob)))] == places
        assert split < 1 << 20 or Counted.read_bytes <= 2 * len(blob)
    broken = bytearray(blob)
    broken[places[80] + 20 : places[80] + 60] = bytes(40)
    assert [at for at, _, _ in warc.scan(Counted(bytes(broken)), 0, len(blob))] == places[:80] + places[81:]
    assert len(list(warc.scan(Counted(blob[:-5]), 0, len(blob) - 5))) == 199


def test_archives_of_odd_pages(spark):
    pages = spark.createDataFrame([(None, "u", "same"), (4, None, "same"), (4, "v", "same"), (2, "w", ""), (1, "w", None)], "page_id long, url string, html string")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read(warc.write(pages), split_bytes=50).collect()), key=str)
    assert got == sorted([(None, 4, "revisit", 4), (4, 4, "response", None), (4, 4, "response", None), (2, 0, "response", None), (1, 0, "revisit", 2)], key=str)
    assert warc.op1_warc(spark, pages.limit(0)).count() == 0


def test_small_archives_share_tasks_and_files(spark):
    pages = spark.range(300).selectExpr("id as page_id", "'u' as url", "repeat(string(id % 200), 50) as html").repartition(12)
    files = warc.write(pages)
    assert files.where("bytes > 0").count() == 12 and len(files.inputFiles()) == 1
    found = warc.read(files, split_bytes=1 << 20)
    assert found.rdd.getNumPartitions() == 1
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in found.collect()) == [(i, "revisit", i + 200) if i < 100 else (i, "response", None) for i in range(300)]
    assert warc.read(files, split_bytes=100).rdd.getNumPartitions() > 12


def model_logs(training, texts, depth, least, penalty, discount):
    """The tree's log10 probabilities of token lists, in plain Python."""
    count = Counter(tuple(t[i : i + n]) for t in training for n in range(1, depth + 2) for i in range(len(t) - n + 1))
    total = sum(map(len, training))
    limit = max(2, math.ceil(total * least))
    words = {g[0]: c for g, c in count.items() if len(g) == 1}
    often = {g: c for g, c in count.items() if c >= limit}
    root = lambda w: (words[w] - 0.5 if w in words else 0.5 * len(words) + 1) / (total + 1)
    states = {}

    def p(context, w):
        while context and context not in states:
            context = context[1:]
        if not context:
            return root(w)
        n, left, own = states[context]
        return (max(own.get(w, 0) - discount, 0) if w in own else 0) / n + left * p(context[1:], w)

    for length in range(1, depth + 1):
        new = {}
        for context in {g[:-1] for g in often if len(g) == length + 1}:
            own = {g[-1]: c for g, c in often.items() if g[:-1] == context}
            n = count[context]
            rest, apart = n - sum(own.values()), 1 - sum(p(context[1:], w) for w in own)
            gain = sum(c * math.log(c / n / p(context[1:], w)) for w, c in own.items()) + (rest * math.log(rest / n / apart) if rest else 0)
            if gain > penalty * (len(own) + (rest > 0)):
                new[context] = (n, (rest + discount * len(own)) / n, own)
        states |= new
    return [sum(math.log10(p(tuple(t[max(0, i - depth) : i]), w)) for i, w in enumerate(t)) for t in texts], total, words, len(states)


@pytest.mark.parametrize("most", [8_000_000, 90])
def test_suffix_tree_by_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(pst, "MOST_SENT", most)
    rng = random.Random(8)
    follow = {w: [rng.choice("abcdefgh") for _ in range(2)] for w in "abcdefgh"}
    rows = []
    for i in range(60):
        w, out = "a", []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(follow.get(w, "abcdefgh")) if rng.random() < 0.8 else rng.choice([*"abcdefgh", f"r{rng.randrange(400)}"])
            out.append(w)
        rows.append((i, " ".join(out).upper() if i % 4 else "  ".join(out)))
    rows += [(100, None), (101, ""), (None, "a b zz9"), (102, "a b " * 3000)]
    tokens = {i: [*(t or "").lower().split(), None] for i, t in rows}
    held = {i: i is not None and crc32(str(i).encode()) % 5 == 1 for i in tokens}
    training = [t for i, t in tokens.items() if not held[i]]
    logs, total, words, states = model_logs(training, list(tokens.values()), 3, 0.002, 2.0, 0.8)
    assert states > 8
    got = {r.doc_id: r for r in pst.score(spark.createDataFrame(rows, TEXTS).repartition(3), least=0.002).collect()}
    floor = math.log10(total + 0.5 * (len(words) + 1))
    for (i, t), log in zip(tokens.items(), logs, strict=True):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(w in words for w in t), total)
        assert r.base_score == pytest.approx(sum(math.log10(words.get(w, 0) + 0.5) - floor for w in t)) and r.score == pytest.approx(log)


def test_suffix_tree_grows_with_the_corpus():
    limits = [pst.frequent_count(n, pst.LEAST / n ** (1 / 3)) for n in (10**4, 10**8, 10**10, 10**13)]
    assert limits == [2, 22, 465, 46416]
    assert all(a / x < b / y for (a, x), (b, y) in zip(zip((10**4, 10**8, 10**10), limits), zip((10**8, 10**10, 10**13), limits[1:]), strict=False))


def test_suffix_tree_without_training_rows(spark):
    only = next(i for i in range(99) if crc32(str(i).encode()) % 5 == 1)
    got = pst.op2_suffix_tree(spark, spark.createDataFrame([(only, "a b")], TEXTS)).first()
    assert (got.n_tokens, got.n_known, got.train_tokens, got.base_score, got.score) == (3, 0, 0, 0.0, 0.0)


def test_filters_follow_deletions_and_batches(spark):
    line = lambda i: f"a line of more than twenty characters {i}"
    make = lambda rows: spark.createDataFrame(rows, TEXTS)
    first, second = make([(i, f"{line(i)}\n{line(i // 2)}") for i in range(40)] + [(None, line(0))] * 2), make([(100 + i, line(i + 30)) for i in range(40)])
    index = line_dedup.LineIndex(spark)
    index.insert(first)
    index.insert(make([]))
    index.insert(second)
    keys = lambda a, b: line_dedup._as_words(__import__("pyarrow").array([line_dedup.key_of(line(i).encode(), 20) for i in range(a, b)]))
    held = lambda a, b: line_dedup.CuckooFilter.load(bytes(index._table("filters").first()["filter"])).contains(keys(a, b))
    assert held(0, 70).all() and not held(1000, 3000).any()
    assert {r.refs for r in index.counts.where("max_doc is null or max_doc < 100").collect()} <= {1, 2, 3, 4}
    index.delete(second.select("doc_id"))
    assert held(0, 40).all() and not held(40, 70).any()
    whole, parts = line_dedup.LineIndex(spark), line_dedup.LineIndex(spark)
    both = first.unionByName(second)
    whole.insert(both)
    parts.insert_all(both, 3)
    state = lambda x: sorted(map(tuple, x.counts.select("key", "refs", "max_doc").collect()))
    assert state(whole) == state(parts)


def test_a_host_is_rejected_with_all_its_documents(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "too few" if i < 190 else good, "bad") for i in range(200)] + [(1000 + i, good if i % 20 else "short", f"h{i % 10}") for i in range(400)] + [(2000 + i, good, None) for i in range(50)]
    got = {r.doc_id: r for r in host_rules.op6_host_rules(spark, spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[i].kept for i in range(200)) and not any(got[i].base_failed for i in range(190, 200))
    assert all(got[i].kept == (i < 1000 or i >= 2000 or bool((i - 1000) % 20)) for i in got if i >= 1000)


def test_counts_of_one_text(spark):
    text = "#a* b\n\nx y z\nx y z\n \n<q> x y z|"
    row = host_rules.op6_host_rules(spark, spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")).first()
    assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (12, 17, 5, 1, 6)


def test_packing_ids_are_those_of_the_tokenizers_library(spark):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    slow, encode, rng = Tokenizer.from_file(path), packing.encoder(path), random.Random(2)
    special = [x["content"] for x in json.load(open(path, encoding="utf-8"))["added_tokens"]]
    odd = ["", " ", "\n\n \t", "it's  I'LL", "ünï😀 語 \u200b\u00a0x", "a" * 3000, "1234567 3.14", *special, f"x{special[0] if special else ''}y", "\r\n\x00\x7f"]
    odd += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x2FF), rng.randrange(0x3040, 0x30FF), 32, 10])) for _ in range(80)) for _ in range(200)]
    odd += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").select("text").collect()]
    for text in odd:
        assert encode(text).tolist() == slow.encode(text, add_special_tokens=False).ids, text[:80]


def test_packing_has_no_gaps_and_little_padding(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = rows.unionByName(rows.where("doc_id < 5")).unionByName(spark.createDataFrame([(None, "a b"), (None, "a b")], rows.schema))
    pieces = packing.op7_packing(spark, rows).collect()
    docs = Counter()
    for r in pieces:
        docs[r.doc_id, r.start, r.length, r.doc_tokens] += 1
    for (doc, start, length, total), n in docs.items():
        assert start + length == total or any((d, s) == (doc, start + length) and m >= n for (d, s, _, t), m in docs.items() if t == total)
    sequences = {r.sequence_id for r in pieces}
    assert sequences == set(range(len(sequences))) and sum(r.length for r in pieces) > 0.95 * 2048 * (len(sequences) - 1)


def test_masks_miss_no_overlap():
    spans = [(m, [o for o, c in enumerate(m) if c == "1"]) for m in spaced_seeds.MASKS]
    for window in range(5, spaced_seeds.WINDOW + 1):
        for n in range(spaced_seeds.allowed(window) + 1):
            for changed in combinations(range(window), n):
                assert any(all(at + o not in changed for o in own) for m, own in spans for at in range(window - len(m) + 1)), (window, changed)


def test_leaks_of_a_large_test_set_are_the_same(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    found = lambda: sorted(map(tuple, spaced_seeds.op8_spaced_seeds(spark, docs, items).collect()))
    small = found()
    monkeypatch.setattr(spaced_seeds, "BROADCAST_SEEDS", 0)
    assert found() == small and small
    assert spaced_seeds.op8_spaced_seeds(spark, docs.limit(0), items).count() == spaced_seeds.op8_spaced_seeds(spark, docs, items.limit(0)).count() == 0


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, "you are awful trash" if i % 2 else "a kind word for you") for i in range(60)] + [(1, "you are awful trash"), (None, "awful"), (70, None), (71, "")], TEXTS)
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(60)] + [(1, 0, 0), (None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.op5_toxicity(spark, docs, labels).collect()
    assert len(got) == 64 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 60)
    assert all(r.held_out == (r.doc_id is None or crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    for one in (0, 1):
        assert all(r.predicted == one for r in toxicity.op5_toxicity(spark, docs, labels.where(f"toxic = {one}")).collect() if r.doc_id is not None and r.doc_id < 60 and r.doc_id % 2 == one)
    assert all(r.score == 0.5 for r in toxicity.op5_toxicity(spark, docs, labels.limit(0)).collect())


def test_ftrl_against_a_plain_one():
    rng, model = random.Random(3), toxicity.Ftrl(10, l1=0.3)
    z, n = [0.0] * 11, [0.0] * 11

    def weight(i):
        l1 = 0.0 if i == 10 else 0.3
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / (1 + math.sqrt(n[i]) + 0.1)

    for _ in range(200):
        at, label = [*sorted(rng.sample(range(10), 3)), 10], rng.randrange(2)
        own = [weight(i) for i in at]
        g = 1 / (1 + math.exp(-sum(own))) - label
        for i, w in zip(at, own, strict=True):
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) * w
            n[i] += g * g
        model.learn(np.array(at), label)
    assert model.weights(np.arange(11)).tolist() == pytest.approx([weight(i) for i in range(11)])


def test_leaks_take_no_clean_row_with_the_same_id(spark):
    item = " ".join(f"bench{i}" for i in range(20))
    clean = " ".join(f"clean{i}" for i in range(60))
    docs = spark.createDataFrame([(None, clean), (None, f"so {item} so"), (5, clean + " x"), (5, item), (6, None)], TEXTS)
    folder = shared.fresh_path(spark, "bench")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept = pipeline.decontaminate(spark, docs, folder).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(None, clean), (5, clean + " x"), (6, None)], key=str)


def test_digests_are_of_the_bytes():
    data = np.frombuffer(b"some bytes here", np.uint8)
    want = np.frombuffer(hashlib.blake2b(b"bytes", digest_size=8).digest(), np.uint64)[0]
    assert textvec.digests(memoryview(data), np.array([5]), np.array([10]))[0] == want
