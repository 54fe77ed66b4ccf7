"""Queries of this subpackage over the tables of a data folder, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from scorelake.llm import mixing, selection, splits, tokens, truncation
from scorelake.llm.sql import SQL
from scorelake.sources.tables import table


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode(table(spark, folder, "documents"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return selection.near_pairs(selection.standardized(table(spark, folder, "conformers"))).select("conformer_id_a", "conformer_id_b").distinct()


def p4_subset(spark: SparkSession, folder: str) -> DataFrame:
    requests = [(r.request_id, r.subset_size) for r in table(spark, folder, "selection_requests").orderBy("request_id").collect()]
    return selection.select_varied(table(spark, folder, "conformers"), requests)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    sets = splits.linked_sets(table(spark, folder, "ligands"))
    return sets.where(F.col("record") != F.col("anchor")).select(F.col("anchor").alias("anchor_ligand_id"), F.col("record").alias("ligand_id"))


def p5_splits(spark: SparkSession, folder: str) -> DataFrame:
    return splits.assign_splits(table(spark, folder, "ligands"), table(spark, folder, "split_targets"))


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return splits.split_report(p5_splits(spark, folder), table(spark, folder, "ligands"))


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    sizes = mixing.sized_documents(table(spark, folder, "documents"))
    return mixing.mix(sizes, mixing.plan(sizes, table(spark, folder, "mix_targets")))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    sizes = mixing.sized_documents(table(spark, folder, "documents"))
    planned = mixing.plan(sizes, table(spark, folder, "mix_targets"))
    return mixing.shares(mixing.mix(sizes, planned), planned)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.score(table(spark, folder, "documents")).where("cut").select("doc_id")


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.source_rates(truncation.score(table(spark, folder, "documents")))


__all__ = ["QUERIES", "SQL"]
QUERIES = {q.__name__: q for q in (p4_found, p4_subset, p5_found, p5_splits, p5_report, p6_ids, p7_mixture, p7_shares, p8_found, p8_rates)}
