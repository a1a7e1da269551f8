"""Duplicates of a stream of records, told as soon as they are known.

What a batch run marks never loses its mark when more records arrive: a pair or
fragment that is beaten stays beaten.  So the state of a cluster is its winner
alone.  A newcomer that loses is a duplicate at once, one that wins makes the old
winner one; a fragment is one when a paired record comes to its place.  All marks
told so far are what a batch run over the same records gives, in whatever order
and batches these came.

Three streaming steps, each with a checkpoint of its own: mates meet by name,
pairs by cluster, and records by fragment cluster.  With ``idle_ms`` a name or
cluster at which nothing arrived for so long is closed by a timer: its state
goes, and what comes later is told as late instead, for a table aside.  Without
it state is kept, and nothing is late.

Well-formed names are assumed: of an end that is repeated the first to arrive
counts, where a batch run takes the first in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import marking, pairing

#: Columns of an end that a pair needs.
END = "line_no long, pos long, flag int, ref_idx int, mate_idx int, u long, score int, lb int, rev int, mrev int"
END_NAMES = [c.split()[0] for c in END.split(", ")]
PAIR = "bucket string, qname string, late boolean, " + ", ".join(f"{e}_{c}" for e in "ab" for c in END.split(", "))
MARK = "line_no long, late boolean"
RANK = "rank array<long>, lines array<long>"


class Closing(StatefulProcessor):
    """State for one key, which a timer closes when nothing has arrived for ``idle_ms``."""

    SCHEMA = ""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.SCHEMA)
        if self.idle_ms:
            self.closed, self.timer = handle.getValueState("closed", "at long"), handle.getValueState("timer", "at long")

    def waits(self, timers: Any) -> bool:
        """Whether the key is open; if it is, it stays so for idle_ms from now."""
        if not self.idle_ms:
            return True
        if self.closed.exists():
            return False
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        at = timers.getCurrentProcessingTimeInMs() + self.idle_ms
        self.handle.registerTimer(at)
        self.timer.update((at,))
        return True

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.closed.update((expiredTimerInfo.getExpiryTimeInMs(),))
        self.held.clear()
        self.timer.clear()
        yield pd.DataFrame(columns=self.NAMES)

    def close(self) -> None:
        pass


class Mates(Closing):
    """Pairs of both ends of a name; a record of a closed name is told as a pair of itself alone, late."""

    SCHEMA = "end int, " + END
    NAMES = [c.strip().split(" ")[0] for c in PAIR.split(",")]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        bucket, qname = key
        waits, out = self.waits(timerValues), []
        for frame in rows:
            for row in frame[["end", *END_NAMES]].itertuples(index=False, name=None):
                row = tuple(int(x) for x in row)
                if not waits:
                    out.append((bucket, qname, True, *row[1:], *[None] * len(END_NAMES)))
                elif not self.held.exists():
                    self.held.update(row)
                elif (first := tuple(self.held.get()))[0] not in (0, row[0]):
                    a, b = sorted((first[1:], row[1:]), key=lambda e: (e[1], e[0]))
                    out.append((bucket, qname, False, *a, *b))
                    self.held.update((0, *row[1:]))  # the name is complete
        yield pd.DataFrame(out, columns=self.NAMES).astype({c: "Int64" for c in self.NAMES[3:]})


class Winner(Closing):
    """The best of a cluster of pairs; all others are duplicates."""

    SCHEMA = RANK
    NAMES = ["line_no", "late"]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        waits, out = self.waits(timerValues), []
        best = tuple(map(list, self.held.get())) if self.held.exists() else None
        for frame in rows:
            for late, score, pos, line, other in frame[["late", "pair_score", "rep_pos", "rep_line", "oth_line"]].itertuples(index=False, name=None):
                if late or not waits:
                    out += [(x, True) for x in (line, other) if not pd.isna(x)]
                    continue
                new = ([int(score), -int(pos), -int(line)], [int(line), int(other)])
                lost = new if best is not None and best[0] > new[0] else best
                best = best if lost is new else new
                out += [(x, False) for x in lost[1]] if lost else []
        if best is not None:
            self.held.update(best)
        yield pd.DataFrame(out, columns=self.NAMES)


class Fragments(Closing):
    """The best unpaired record of a place where no paired one is; with a paired one all unpaired ones are duplicates."""

    SCHEMA = RANK
    NAMES = ["line_no", "late"]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        waits, out = self.waits(timerValues), []
        best = tuple(map(list, self.held.get())) if self.held.exists() else None
        for frame in rows:
            for paired, score, mate, pnext, pos, line in frame[["paired", "score", "mate_idx", "pnext", "pos", "line_no"]].itertuples(index=False, name=None):
                if not waits:
                    out += [] if paired else [(line, True)]
                    continue
                # A paired record has an empty rank and no lines, and beats all.
                new = ([], []) if paired else ([int(score), -int(mate), -int(pnext), -int(pos), -int(line)], [int(line)])
                lost = new if best is not None and (not best[0] or new[0] and best[0] > new[0]) else best
                best = best if lost is new else new
                out += [(x, False) for x in lost[1]] if lost else []
        if best is not None:
            self.held.update(best)
        yield pd.DataFrame(out, columns=self.NAMES)


def _step(rows: DataFrame, key: list[str], processor: Closing, schema: str) -> DataFrame:
    return rows.groupBy(*key).transformWithStateInPandas(processor, schema, "Append", "ProcessingTime" if processor.idle_ms else "None")


def start(reads: DataFrame, folder: str, *, idle_ms: int = 0, trigger: dict | None = None) -> list[StreamingQuery]:
    """Start the three steps on a stream of routed records (marking.NARROW): the marks so far are ``read``.

    Files and checkpoints are under folder, which executors share.  trigger as for
    DataStreamWriter.trigger; with availableNow, or another that ends, the second
    step sees what the first wrote before it started.
    """
    spark = reads.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    trigger = trigger or {"processingTime": "10 seconds"}

    def run(rows: DataFrame, name: str) -> StreamingQuery:
        query = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoints/{name}").trigger(**trigger)
        return query.start(f"{folder}/{name}")

    ends = reads.where("eligible and paired").select("bucket", "qname", "end", *END_NAMES)
    mates = run(_step(ends, ["bucket", "qname"], Mates(idle_ms), PAIR), "mates")
    singles = reads.where("eligible").select(*marking.FRAGMENT_KEY, "paired", "score", "mate_idx", "pnext", "pos", "line_no")
    fragments = run(_step(singles, list(marking.FRAGMENT_KEY), Fragments(idle_ms), MARK), "fragments")
    if "availableNow" in trigger or "once" in trigger:
        mates.awaitTermination()
    stored = spark.readStream.schema(PAIR).parquet(f"{folder}/mates")
    sides = [F.struct(*[F.col(f"{e}_{c}").alias(c) for c in END_NAMES]).alias(e) for e in "ab"]
    pairs = pairing.ends_of(stored.select("bucket", "qname", "late", *sides), "late")
    return [mates, fragments, run(_step(pairs, list(marking.PAIR_KEY), Winner(idle_ms), MARK), "pairs")]


def read(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(line_no) of all duplicates told so far, and of all records that came too late to be judged."""
    told = spark.read.schema(MARK).parquet(f"{folder}/fragments").unionByName(spark.read.schema(MARK).parquet(f"{folder}/pairs"))
    return told.where("not late").select("line_no"), told.where("late").select("line_no")
