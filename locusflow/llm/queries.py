"""The registered queries of this subpackage and the SQL for their rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, hard_negatives, host_rules, line_dedup, lsh_forest, packing, prefix_join, pst, spaced_seeds, suffix_dedup, toxicity, warc, window_index


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op1_warc(spark, table(spark, sf_dir, "pages"))


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pst.op2_suffix_tree(spark, table(spark, sf_dir, "documents"))


def op3_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.op3_lsh_forest(spark, table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op4_line_dedup(spark, table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op5_toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.op6_host_rules(spark, table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op7_packing(spark, table(spark, sf_dir, "documents"))


def op8_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seeds.op8_spaced_seeds(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_window_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_index.op9_window_index(spark, table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.op10_suffix_dedup(spark, table(spark, sf_dir, "documents"))


def op11_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.op11_dual_tree(spark, table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.op13_collocations(spark, table(spark, sf_dir, "documents"))


def op12_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_join.op12_prefix_join(spark, table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_suffix_tree": op2_suffix_tree,
    "op3_lsh_forest": op3_lsh_forest,
    "op4_line_dedup": op4_line_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_host_rules": op6_host_rules,
    "op7_packing": op7_packing,
    "op8_spaced_seeds": op8_spaced_seeds,
    "op9_window_index": op9_window_index,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_dual_tree": op11_dual_tree,
    "op13_collocations": op13_collocations,
    "op12_prefix_join": op12_prefix_join,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": warc.ORACLE_SQL,
    "op3_lsh_forest": lsh_forest.ORACLE_SQL,
    "op4_line_dedup": line_dedup.ORACLE_SQL,
    "op6_host_rules": host_rules.ORACLE_SQL,
    "op8_spaced_seeds": spaced_seeds.ORACLE_SQL,
    "op9_window_index": window_index.ORACLE_SQL,
    "op11_dual_tree": hard_negatives.ORACLE_SQL,
    "op13_collocations": collocations.ORACLE_SQL,
    "op12_prefix_join": prefix_join.ORACLE_SQL,
}
