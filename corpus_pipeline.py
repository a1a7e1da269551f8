"""The corpus pipeline: quality rules, line and near deduplication, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept,
and its result is written as Parquet to the shared folder and read again.  All
but the last return the columns of documents; n_chars follows the text where
there is such a column.  Null texts count as empty; documents with a null id
are judged by the rules, lines and benchmark like others but never count as
copies.  An empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.llm import host_rules, line_dedup, lsh_forest, packing, shared, spaced_seeds

ID, TEXT = "doc_id", "text"


def _as_documents(rows: DataFrame, docs: DataFrame) -> DataFrame:
    out = rows.select(*shared.unpacked(docs, ID, TEXT))
    return out.withColumn("n_chars", F.length(TEXT).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that fail the base rules or whose host is rejected."""
    judged = host_rules.assess(docs, id_col=ID, text_col=TEXT, with_text=True)
    return judged.where("kept").select(*shared.unpacked(docs, ID, TEXT))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that three documents and more hold, but for the largest id."""
    index = line_dedup.LineIndex(spark, id_col=ID, text_col=TEXT)
    index.insert_all(docs)
    return _as_documents(index.rewrite(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity of 0.8 and more on five-word shingles): the least id."""
    out = lsh_forest.near_duplicates(docs, id_col=ID, text_col=TEXT, percent=80)
    return out.where("kept or __id is null").select(*shared.unpacked(docs, ID, TEXT))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a passage of the benchmark; equal texts are judged alike, whatever their ids."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    texts = docs.select(F.xxhash64(TEXT).alias("key"), F.col(TEXT).alias("text"))
    found = spaced_seeds.leaks(texts, benchmark, id_col="key").select("doc_id").distinct()
    return docs.join(found, F.xxhash64(docs[TEXT]) == found["doc_id"], "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, in sequences of 2048 ids."""
    return packing.op7_packing(spark, docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontamination", decontaminate), ("packing", pack)]

#: SQL cannot express the pipeline: packing needs the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's table goes when the next one's is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            shared.dropped(before)
        before = docs
    return docs
