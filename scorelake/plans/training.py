"""General training-data queries over the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorelake.operators import drift, shred
from scorelake.operators.reconcile import copies_differ
from scorelake.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return copies_differ(*(table(spark, folder, n) for n in ("seed_scores", "seed_scores_mirror", "receptors", "receptors_mirror")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return drift.changes(drift.path_rows(table(spark, folder, "stage_files")))


def _unified(spark: SparkSession, folder: str) -> DataFrame:
    paths = drift.path_rows(table(spark, folder, "stage_files"))
    return drift.unified_paths(paths, drift.changes(paths))


def p2_table(spark: SparkSession, folder: str) -> DataFrame:
    return drift.consistent_table(_unified(spark, folder))


def p2_path_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return drift.path_statistics(drift.path_rows(table(spark, folder, "stage_files")))


def p2_failed_casts(spark: SparkSession, folder: str) -> DataFrame:
    """Values that ``p2_table`` can't hold in their column."""
    return drift.typed_values(_unified(spark, folder)).where("failed").select("lineage_id", "file_id", "path", "own_path", "wanted", "raw_type", "raw_value")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return shred.hashed_objects(shred.shred(table(spark, folder, "run_records")))


def p3_objects(spark: SparkSession, folder: str) -> DataFrame:
    return shred.object_table(shred.shred(table(spark, folder, "run_records")))


def p3_occurrences(spark: SparkSession, folder: str) -> DataFrame:
    return shred.occurrence_table(shred.shred(table(spark, folder, "run_records")))


def p3_places(spark: SparkSession, folder: str) -> DataFrame:
    """The bridge rows without their hashes."""
    return p3_occurrences(spark, folder).select("record_id", "node_path", "parent_path", "owner_path", "field", "ordinal")


def p3_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences and records of each kind of place."""
    return shred.entity_kinds(shred.shred(table(spark, folder, "run_records"))).drop("objects")


def p3_entities(spark: SparkSession, folder: str) -> DataFrame:
    """The flat table of the entries of ``receptors``, with their links to the record and the objects around."""
    return shred.entity_table(shred.shred(table(spark, folder, "run_records")), "receptors")


QUERIES = {q.__name__: q for q in (p1_found, p2_found, p2_table, p2_path_statistics, p2_failed_casts, p3_found, p3_objects, p3_occurrences, p3_places, p3_kinds, p3_entities)}
