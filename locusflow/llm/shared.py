"""The shared folder, written tables that cut lineage, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges whose components one task finds; more are handled by steps over all.
FEW_EDGES = 1_000_000
#: Ids, of 8 bytes, that are broadcast to a table at most.
SENT_IDS = 200_000


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        folder = f"file://{tempfile.gettempdir()}/locusflow-shared"  # one process: nothing to share with
        spark.sparkContext.setCheckpointDir(folder)
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/locusflow/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, read again: its lineage ends there and executors can be lost."""
    spark = session(df)
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Hadoop, as only Spark may reach it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` which nothing reads any more."""
    spark = session(df)
    for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        if "/locusflow/" in path:
            remove(spark, path)


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Arrow batches of about ``size`` bytes at most for what is run inside; the session's own setting comes back after."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def id_batches(docs: DataFrame, id_col: str, batches: int) -> list[DataFrame]:
    """docs in up to ``batches`` parts of ascending ids, of about as many rows each; null ids are in the first."""
    own = F.col(f"`{id_col}`")
    bounds = docs.select(F.percentile_approx(own, [i / batches for i in range(1, batches)]) if batches > 1 else F.lit(None)).first()[0] or []
    out, rest = [], docs
    for bound in sorted(set(bounds)):
        out.append(rest.where((own <= bound) if out else own.isNull() | (own <= bound)))
        rest = docs.where(own > bound)
    return [*out, rest]


def only(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows of df whose column, a long, is in ids; few ids, by their count, go to the rows, else both are shuffled."""
    ids = written(ids.select(column).distinct(), "ids")
    return df.join(F.broadcast(ids) if ids.count() <= SENT_IDS else ids, column, "left_semi")


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(session(df))
    return df.checkpoint()


def released(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished steps."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def pieces(df: DataFrame, column: str, target_bytes: int = 16 << 20, least: int = 1) -> int:
    """A number of partitions for about ``target_bytes`` of text each."""
    total = df.select(F.sum(F.octet_length(F.col(column)).cast("long"))).first()[0] or 0
    return max(least, -(-int(total) // target_bytes))


def _of_few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all edges that come, by hooking to the least label and halving paths."""
    edges = [np.stack([x["a"].to_numpy(), x["b"].to_numpy()]) for x in batches]
    if not edges:
        return
    nodes, ends = np.unique(np.concatenate(edges, 1), return_inverse=True)
    a, b = ends.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        if (low == high).all():
            break
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, component), component the least node reachable.

    FEW_EDGES at most meet in one task of an executor.  Of more, alternates large-star and small-star steps until no edge changes; every step
    is two aggregations over edges, hot nodes are pre-aggregated to their least
    neighbour and the links of a large node are spread by the join's skew
    handling.  Nulls are ignored; no edges give no rows.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if edges.count() <= FEW_EDGES:
        return edges.repartition(1).mapInArrow(_of_few, "node long, component long")
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large-star: neighbours above u point to u's least neighbour.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("b"), F.col("m").alias("a")).where("a <> b").distinct()
        # Small-star: u and its lower neighbours point to the least of them.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select("a", "b", "m")
        new = small.select(F.col("m").alias("a"), F.col("b")).union(small.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
        new = written(new, "edges")
        changed = new.join(edges, ["a", "b"], "left_anti").limit(1).count() or new.count() != edges.count()
        edges = new
        if not changed:
            break
    stars = edges.groupBy("b").agg(F.min("a").alias("component")).withColumnRenamed("b", "node")
    roots = edges.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return stars.union(roots.join(stars.select("node"), "node", "left_anti"))


def packed(docs: DataFrame, id_col: str, text_col: str, others: bool = True) -> DataFrame:
    """docs as (__id, __text, __rest): all further columns in one struct, so that no name can clash with an operator's own."""
    rest = [c for c in docs.columns if c not in (id_col, text_col)] if others else []
    return docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"), F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(True).alias("__here")).alias("__rest"))


def unpacked(docs: DataFrame, id_col: str, text_col: str) -> list:
    """The columns of docs, in order, from what ``packed`` made."""
    own = {id_col: F.col("__id").alias(id_col), text_col: F.col("__text").alias(text_col)}
    return [own.get(c, F.col("__rest").getField(c).alias(c)) for c in docs.columns]
