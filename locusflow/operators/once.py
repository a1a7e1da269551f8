"""Tables that several steps read, written once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh(spark: SparkSession) -> str:
    """A new path in the folder of spark.checkpoint.dir.

    Without that setting a session in one process gets a folder of its own; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='locusflow-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/locusflow-reads/{uuid.uuid4().hex}"


def once(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder, read again: steps that share it don't derive it each, and executors can be lost."""
    spark = df.sparkSession
    path = fresh(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
