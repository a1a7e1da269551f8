"""Marks of a stream of shuffled files against the batch run."""

import random

import pandas as pd

from locusflow import queries
from locusflow.operators import marking
from locusflow.streaming import marks

SF = "/root/testdata/sf0.001"


def files(spark, rows, folder, n, seed):
    rng = random.Random(seed)
    rng.shuffle(rows)
    for i in range(n):
        spark.createDataFrame(rows[i::n], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


SCHEMA = None


def test_shuffled_files_give_the_marks_of_a_batch(spark, tmp_path):
    global SCHEMA
    narrow = queries.reads(spark, SF).where("line_no < 30000").select(*marking.NARROW)
    SCHEMA = narrow.schema
    rows = narrow.collect()
    want = sorted(r.line_no for r in marking.losers(spark.createDataFrame(rows, SCHEMA)).collect())
    source, out = tmp_path / "in", str(tmp_path / "out")
    for round_, part in enumerate((rows[: len(rows) // 3], rows[len(rows) // 3 :])):  # the second round starts from the checkpoints
        files(spark, list(part), source, 2, round_)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
        for query in marks.start(stream, out, trigger={"availableNow": True}):
            query.awaitTermination()
    told, late = marks.read(spark, out)
    assert sorted(r.line_no for r in told.collect()) == want != [] and late.count() == 0


class Value:
    """A value state in memory."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def getValueState(self, name, schema):
        return self.states.setdefault(name, Value())

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now

    getExpiryTimeInMs = getCurrentProcessingTimeInMs


def test_what_comes_after_a_timer_is_late():
    handle, steps = Handle(), marks.Winner(100)
    steps.init(handle)
    frame = lambda *lines: iter([pd.DataFrame([(False, score, 5, line, line + 1) for score, line in lines], columns=["late", "pair_score", "rep_pos", "rep_line", "oth_line"])])

    def told(now, *lines):
        return [tuple(r) for d in steps.handleInputRows(("key",), frame(*lines), Clock(now)) for r in d.itertuples(index=False)]

    assert told(0, (50, 10), (60, 20)) == [(10, False), (11, False)] and handle.timers == [100]
    assert told(40, (70, 30)) == [(20, False), (21, False)] and handle.timers == [140]  # put off by what arrives
    list(steps.handleExpiredTimer(("key",), Clock(140), Clock(140)))
    assert told(200, (99, 40)) == [(40, True), (41, True)] and not handle.states["held"].exists()


def test_names_wait_for_their_other_end():
    handle, steps = Handle(), marks.Mates(100)
    steps.init(handle)

    def told(now, *ends):
        rows = pd.DataFrame([(end, no, no, *[0] * 8) for end, no in ends], columns=["end", *marks.END_NAMES])
        return [(r.late, r.a_line_no, r.b_line_no) for d in steps.handleInputRows(("chr1", "q"), iter([rows]), Clock(now)) for r in d.itertuples(index=False)]

    assert told(0, (1, 7)) == [] and told(1, (1, 8)) == [] and told(2, (2, 5)) == [(False, 5, 7)] and told(3, (2, 6), (1, 9)) == []
    list(steps.handleExpiredTimer(("chr1", "q"), Clock(140), Clock(140)))
    ((late, line, other),) = told(200, (1, 3))
    assert late and line == 3 and pd.isna(other)


def test_fragments_and_pairs_at_one_place():
    handle, steps = Handle(), marks.Fragments(0)
    steps.init(handle)

    def told(*rows):
        frame = pd.DataFrame([(paired, score, 0, 9, 9, line) for paired, score, line in rows], columns=["paired", "score", "mate_idx", "pnext", "pos", "line_no"])
        return [r.line_no for d in steps.handleInputRows(("key",), iter([frame]), Clock(0)) for r in d.itertuples(index=False)]

    assert told((False, 5, 1)) == [] and told((False, 5, 2), (False, 9, 3)) == [2, 1] and told((True, 1, 4)) == [3] and told((False, 99, 5), (True, 0, 6)) == [5]
