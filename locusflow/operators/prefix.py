"""Sums over all rows before a row in a sorted order, in two passes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .once import once


def running_sums(rows: DataFrame, key: str, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """rows with ``before_<value>``: the sum of each value (longs) over the rows of the same key (text) that come before in the order.

    Rows are range-partitioned by key and order, so a key or a position that
    holds much of the input is in several tasks.  Each task sums what it has, and
    the totals of tasks and keys, a few rows a task, give what comes before its
    first row.  Null values count as 0.  Rows of equal order have any order among
    themselves; an empty table gives no rows.
    """
    sums = [f"before_{v}" for v in values]
    schema = ", ".join(f"`{c}` {t}" for c, t in [*rows.dtypes, ("__task", "int"), *((s, "bigint") for s in sums)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, current, carry = TaskContext.get().partitionId(), None, np.zeros(len(values), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch[key].dictionary_encode()
            codes = names.indices.fill_null(-1).to_numpy()
            cuts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            size = np.diff(np.append(cuts, len(codes)))
            first = batch[key][0].as_py()
            if first != current:
                carry = np.zeros(len(values), np.int64)
            out = []
            for i, v in enumerate(values):
                value = batch[v].fill_null(0).to_numpy()
                total = np.cumsum(value) - value
                base = total[cuts].copy()
                base[0] -= carry[i]
                out.append(total - np.repeat(base, size))
                carry[i] = out[-1][-1] + value[-1]
            current = batch[key][batch.num_rows - 1].as_py()
            columns = [*batch.columns, pa.array(np.full(len(codes), task, np.int32)), *map(pa.array, out)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "__task", *sums])

    local = once(rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).mapInArrow(scan, schema))
    ends = local.groupBy(key, "__task").agg(*[F.sum(v).alias(v) for v in values]).orderBy(key, "__task").collect()  # a row a task, and one more a key
    bases, seen = [], {}
    for r in ends:
        before = seen.get(r[key], [0] * len(values))
        bases.append((r[key], r["__task"], *before))
        seen[r[key]] = [a + (r[v] or 0) for a, v in zip(before, values, strict=True)]
    spark = rows.sparkSession
    base = spark.createDataFrame(bases, f"__key string, __at int, {', '.join(f'__{v} long' for v in values)}")
    out = local.join(F.broadcast(base), F.col(key).eqNullSafe(F.col("__key")) & (F.col("__task") == F.col("__at")))
    return out.select(*rows.columns, *[(F.col(s) + F.col(f"__{v}")).alias(s) for s, v in zip(sums, values, strict=True)])
