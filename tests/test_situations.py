"""Situations of marking, each on a chromosome of its own; ill-formed input; and random reads against a plain reading of the rules."""

import random
import re
from collections import defaultdict

import pytest

from locusflow.plans import mark_duplicates as plan

HIGH, LOW = "I" * 10, "5" * 10


def rec(name, flag, pos, cigar="10M", pnext=None, qual=HIGH, lb="LB:Z:L1", rnext="=", mapq=60, rname="@"):
    return (name, flag, rname, pos, mapq, cigar, rnext, pos if pnext is None else pnext, 0, "A" * 10, qual, *([lb] if lb else []))


def pair(name, pos=100, mate=200, cigar="10M", mate_cigar="10M", flags=(99, 147), **more):
    return [rec(name, flags[0], pos, cigar, mate, **more), rec(name, flags[1], mate, mate_cigar, pos, **more)]


def both(*names, flags=(99, 147)):
    return {(n, f) for n in names for f in flags}


A = pair("a")
SITUATIONS = {
    "equal pairs: the later one": (A + pair("b"), both("b")),
    "three equal pairs": (A + pair("b") + pair("c"), both("b", "c")),
    "soft clip into the cluster": (A + pair("b", 102, cigar="2S8M"), both("b")),
    "soft clip out of the cluster": (A + pair("b", 100, cigar="2S8M"), set()),
    "hard clip into the cluster": (A + pair("b", 103, cigar="3H10M"), both("b")),
    "of two clips the outer one counts": (A + pair("b", 102, cigar="2H3S10M"), both("b")),
    "of two clips the inner one doesn't": (A + pair("b", 105, cigar="2H3S10M"), set()),
    "clip at the far end of a forward read": (A + pair("b", cigar="8M2S"), both("b")),
    "clip at the far end of a reverse read": (A + pair("b", mate_cigar="8M2S"), both("b")),
    "deletion lengthens": (A + pair("b", mate=198, mate_cigar="5M2D5M"), both("b")),
    "insertion does not": (A + pair("b", mate=202, mate_cigar="5M2I3M"), both("b")),
    "skipped, equal and different bases lengthen": (A + pair("b", mate=201, mate_cigar="3=2N4X"), both("b")),
    "padding does not": (A + pair("b", mate=202, mate_cigar="4M3P4M"), both("b")),
    "mates apart": (A + pair("b", mate=201), set()),
    "score decides": (pair("low", qual=LOW) + A, both("low")),
    "both ends' scores count": ([rec("x", 99, 100, pnext=200, qual=LOW), rec("x", 147, 200, pnext=100), rec("y", 99, 100, pnext=200, qual="?" * 10), rec("y", 147, 200, pnext=100, qual="?" * 10)], both("x") if 200 + 400 < 2 * 300 else both("y")),
    "bases below fifteen don't count": (pair("x", qual="." * 10) + pair("y", qual="!" * 9 + "0"), both("x")),
    "mapping quality is ignored": (pair("x", qual=LOW, mapq=60) + pair("y", mapq=0), both("x")),
    "names are ignored": (pair("z") + A, both("a")),
    "names in any order of the file": ([A[0], *pair("b")[::-1], A[1]], both("b")),
    "another library": (A + pair("b", lb="LB:Z:L2"), set()),
    "no library is the first one": (A + pair("b", lb=None), both("b")),
    "an unknown library is the first one": (A + pair("b", lb="LB:Z:other"), both("b")),
    "the tag need not come first": (A + [(*r[:11], "X:i:1", r[11]) for r in pair("b")], both("b")),
    "forward pairs and mixed ones": (A + pair("b", mate=209, flags=(65, 129)), set()),
    "two forward pairs": (pair("a", mate=209, flags=(65, 129)) + pair("b", mate=209, flags=(65, 129)), both("b", flags=(65, 129))),
    "two reverse pairs": (pair("a", flags=(113, 177)) + pair("b", flags=(113, 177)), both("b", flags=(113, 177))),
    "outward pairs": (pair("a", mate=300, flags=(83, 163)) + pair("b", mate=300, flags=(83, 163)), both("b", flags=(83, 163))),
    "second end first": (pair("a", flags=(163, 83)) + pair("b", flags=(163, 83)), both("b", flags=(163, 83))),
    "ends on one place": (pair("a", mate=109, flags=(83, 163)) + pair("b", mate=109, flags=(83, 163)), both("b", flags=(83, 163))),
    "ends that cross": (pair("a", mate=101, flags=(83, 163)) + pair("b", mate=101, flags=(83, 163)), both("b", flags=(83, 163))),
    "first and second end exchanged": (A + pair("b", flags=(163, 83)), both("b", flags=(163, 83))),
    "a fragment where a pair begins": (A + [rec("f", 73, 100)], {("f", 73)}),
    "a fragment where a mate ends": (A + [rec("f", 89, 204, "6M")], {("f", 89)}),
    "a fragment on the other strand": (A + [rec("f", 89, 91)], set()),
    "a better fragment loses to a pair": (pair("a", qual=LOW) + [rec("f", 73, 100)], {("f", 73)}),
    "two fragments": ([rec("f", 73, 100, qual=LOW), rec("g", 73, 100)], {("f", 73)}),
    "equal fragments: the nearer mate wins": ([rec("f", 73, 100, pnext=150), rec("g", 73, 100, pnext=120)], {("f", 73)}),
    "equal fragments: the earlier wins": ([rec("f", 73, 100), rec("g", 137, 100)], {("g", 137)}),
    "unmapped mates at one place": ([rec("f", 73, 100), rec("f", 133, 100, "*"), rec("g", 137, 100, qual=LOW), rec("g", 69, 100, "*")], {("g", 137)}),
    "unmapped on the reverse strand": ([rec("f", 121, 100), rec("f", 181, 100, "*"), rec("g", 121 - 16, 100), rec("g", 117, 100, "*")], set()),
    "secondary records stay": (A + [rec("s", 99 | 256, 100, pnext=200), rec("f", 73 | 256, 100)], set()),
    "supplementary records stay": (A + [rec("s", 99 | 2048, 100, pnext=200), rec("f", 73 | 2048, 100)], set()),
    "an existing mark changes nothing": (pair("a", flags=(1123, 1171)) + pair("b"), both("b")),
    "single-end in a bucket": (A + [rec("f", 0, 100)], {("f", 0)}),
    "single-end without a next reference": (A + [rec("f", 0, 100, rnext="*")], set()),
    "a pair that lost its mate": ([rec("p", 99, 100, pnext=200), rec("f", 73, 100)], {("f", 73)}),
    "a clip beyond the start": (pair("a", 1, cigar="4S6M") + pair("b", 1, cigar="4S6M"), both("b")),
    "discordant": ([rec("x", 97, 100, pnext=500, rnext="@b"), rec("x", 145, 500, pnext=100, rname="@b", rnext="@"), rec("y", 97, 100, pnext=500, rnext="@b"), rec("y", 145, 500, pnext=100, rname="@b", rnext="@")], both("y", flags=(97, 145))),
    "discordant and concordant never meet": ([rec("x", 97, 100, pnext=500, rnext="@b"), rec("x", 145, 500, pnext=100, rname="@b", rnext="@"), rec("f", 73, 100)], set()),
}


def lines_of(records, ref):
    return ["\t".join(str(f).replace("@", ref) if i in (2, 6) else str(f) for i, f in enumerate(r)) for r in records]


def write(path, refs, lines):
    path.write_text("\n".join([*(f"@SQ\tSN:{r}\tLN:9999" for r in refs), "@RG\tID:a\tLB:L1", "@RG\tID:b\tLB:L2", *lines]) + "\n")
    return str(path)


@pytest.fixture(scope="module")
def marked(spark, tmp_path_factory):
    refs = [f"s{i}{x}" for i in range(len(SITUATIONS)) for x in ("", "b")]
    lines = [line.replace("\t", f"/{i}\t", 1) for i, (records, _) in enumerate(SITUATIONS.values()) for line in lines_of(records, f"s{i}")]
    path = write(tmp_path_factory.mktemp("situations") / "in.sam", refs, lines)
    out = defaultdict(set)
    for r in plan.marked_sam(spark, path).where("is_dup").select("qname", "flag").collect():
        name, i = r.qname.split("/")
        out[int(i)].add((name, r.flag))
    return out


@pytest.mark.parametrize(("i", "name"), list(enumerate(SITUATIONS)))
def test_situation(marked, i, name):
    assert marked[i] == SITUATIONS[name][1]


ILL = {
    "one end twice": [*A, rec("a", 99, 100, pnext=200)],
    "the other end twice": [*A, rec("a", 147, 200, pnext=100)],
    "both ends twice": A + A,
    "another position": [*A, *pair("a", 150, 250)],
    "another clip": [*A, *pair("a", 102, cigar="2S8M")],
    "another clip of one end": [*A, rec("a", 147, 200, "8M2S", 100)],
    "another strand": [*A, *pair("a", flags=(65, 129))],
}


@pytest.mark.parametrize("name", ILL)
def test_ill_formed_names_raise_if_strict(spark, tmp_path, name):
    path = write(tmp_path / "in.sam", ["s"], lines_of(ILL[name] + pair("other", 500, 600), "s"))
    with pytest.raises(ValueError, match="more than once"):
        plan.marked_sam(spark, path, strict=True)
    assert plan.marked_sam(spark, path).count() == len(ILL[name]) + 2


def test_a_name_on_two_chromosomes_is_well_formed(spark, tmp_path):
    lines = [*lines_of(A + pair("b"), "s"), *lines_of(A, "t")]
    path = write(tmp_path / "in.sam", ["s", "t"], lines)
    assert {(r.qname, r.rname) for r in plan.marked_sam(spark, path, strict=True).where("is_dup").collect()} == {("b", "s")}


def plainly(lines, refs, libraries):
    """Line numbers of duplicates, by the rules read one by one."""
    rows = []
    for no, line in enumerate(lines):
        f = line.split("\t")
        flag, pos, pnext = int(f[1]), int(f[3]), int(f[7])
        mate = f[2] if f[6] == "=" else f[6]
        own, other = (refs.index(x) if x in refs else -1 for x in (f[2], mate))
        bucket = "unmapped" if own < 0 or other < 0 else f[2] if own == other else "discordant"
        ops = re.findall(r"(\d+)(\D)", f[5])
        end = pos + sum(int(n) for n, o in ops if o in "MDN=X") - 1
        u = end + (int(ops[-1][0]) if ops[-1][1] in "SH" else 0) if flag & 16 else pos - (int(ops[0][0]) if ops[0][1] in "SH" else 0)
        tag = next((t[5:] for t in f[11:] if t.startswith("LB:Z:")), None)
        score = min(16383, sum(ord(q) - 33 for q in f[10] if ord(q) - 33 >= 15))
        if bucket != "unmapped" and not flag & 0x904:
            rows.append({"no": no, "name": f[0], "flag": flag, "pos": pos, "pnext": pnext, "ref": own, "mref": other, "bucket": bucket, "u": u, "rev": flag >> 4 & 1, "mrev": flag >> 5 & 1,
                         "lb": libraries.index(tag) if tag in libraries else 0, "score": score, "paired": flag & 9 == 1})
    code = {(0, 0): 2, (0, 1): 3, (1, 1): 4, (1, 0): 5}
    by_name, clusters, fragments, out = defaultdict(list), defaultdict(list), defaultdict(list), set()
    for r in sorted(rows, key=lambda r: (r["pos"], r["no"])):
        if r["paired"]:
            by_name[r["bucket"], r["name"]].append(r)
        fragments[r["bucket"], r["lb"], r["ref"], r["u"], r["rev"]].append(r)
    for (bucket, _), ends in by_name.items():
        if len(ends) == 2:
            a, b = ends
            swap = bucket != "discordant" and b["u"] < a["u"]
            rep, oth = (b, a) if swap else (a, b)
            orient = 3 if a["u"] == b["u"] else code[(b["rev"], a["rev"]) if swap else (a["rev"], a["mrev"])]
            clusters[bucket, rep["lb"], rep["ref"], rep["u"], orient, oth["u"], rep["mref"]].append((-(a["score"] + b["score"]), rep["pos"], rep["no"], oth["no"]))
    for own in clusters.values():
        out |= {no for c in sorted(own)[1:] for no in c[2:]}
    for own in fragments.values():
        single = sorted((-r["score"], r["mref"], r["pnext"], r["pos"], r["no"]) for r in own if not r["paired"])
        if len(own) > 1 and single:
            out |= {s[-1] for s in single[0 if len(single) < len(own) else 1 :]}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_random_reads(spark, tmp_path, seed):
    rng = random.Random(seed)
    refs, lines = ["c1", "c10", "c2"], []
    cigars = ["10M", "2S8M", "8M2S", "1H2S7M", "5M1D5M", "4M2I4M", "3S6M1S", "2M3N5M"]
    for i in range(400):
        ref, two = rng.choice(refs), rng.random() < 0.2
        mate = rng.choice(refs) if two else ref
        kind = rng.random()
        p, q = (rng.randrange(100, 106) for _ in range(2))
        rev, mrev = rng.randrange(2), rng.randrange(2)
        more = {"qual": rng.choice("I5?.") * 10, "lb": rng.choice(["LB:Z:L1", "LB:Z:L2", "LB:Z:x", None])}
        if kind < 0.75:
            ends = [rec(f"n{i}", 1 | 64 | rev << 4 | mrev << 5, p, rng.choice(cigars), q, rname=ref, rnext="=" if ref == mate else mate, **more), rec(f"n{i}", 1 | 128 | mrev << 4 | rev << 5, q, rng.choice(cigars), p, rname=mate, rnext="=" if ref == mate else ref, **more)]
            lines += lines_of(ends if rng.random() < 0.95 else ends[:1], "s")
        else:
            lines += lines_of([rec(f"n{i}", rng.choice([73, 89, 137, 0, 16, 73 | 256, 89 | 2048]), p, rng.choice(cigars), q, rname=ref, rnext=rng.choice(["=", "=", "=", "*"]), **more)], "s")
    rng.shuffle(lines)
    path = write(tmp_path / "in.sam", refs, lines)
    got = {r.line for r in plan.marked_sam(spark, path).where("is_dup").select("line").collect()}
    want = {lines[no] for no in plainly(lines, refs, ["L1", "L2"])}
    assert got == want and len(want) > 50
