"""Files besides Parquet: a table is written in another format to the session's shared folder and read back through the readers of ``sources.files``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.plans.base import query
from scorelake.sources import files
from scorelake.sources.tables import table
from scorelake.storage import scratch_folder


def _place(spark: SparkSession, name: str) -> str:
    return f"{scratch_folder(spark).rstrip('/')}/scorelake/{name}-{uuid.uuid4().hex}"


@query("SELECT target_id, seed_id, ligand_id, receptor_id, gpu_score, status FROM seed_scores")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Scores as CSV with a header, read with an explicit schema; rows that don't fit fail the read."""
    rows = table(spark, d, "seed_scores").select("target_id", "seed_id", "ligand_id", "receptor_id", "gpu_score", "status")
    place = _place(spark, "csv")
    files.write_csv([rows], place)
    return files.read_csv(spark, place, rows.schema)


@query("SELECT target_id, count(*) AS row_count, count(DISTINCT seed_id) AS replicates, count(gpu_score) AS scores FROM seed_scores GROUP BY ALL")
def score_files(spark: SparkSession, d: str) -> DataFrame:
    """Score files of several replicates, with columns in different order, as one table."""
    rows = table(spark, d, "seed_scores")
    first = rows.where("seed_id < 's3'").select("target_id", "seed_id", "ligand_id", "gpu_score")
    second = rows.where("NOT coalesce(seed_id < 's3', false)").select("gpu_score", "ligand_id", "seed_id", "target_id", "status")
    places = [_place(spark, "scores"), _place(spark, "scores")]
    for part, place in zip((first, second), places):
        files.write_csv([part], place)
    every = files.read_score_files(spark, places, ["target_id", "seed_id", "gpu_score"])
    return every.groupBy("target_id").agg(F.count("*").alias("row_count"), F.countDistinct("seed_id").alias("replicates"), F.count(F.col("gpu_score").try_cast("double")).alias("scores"))


@query("SELECT conformer_id AS structure, target_id AS id, count(*) AS line_count FROM receptors WHERE conformer_id IS NOT NULL AND target_id IS NOT NULL GROUP BY ALL")
def id_list_lines(spark: SparkSession, d: str) -> DataFrame:
    """A list of two ids a line, with blank lines between, read back and audited for repeats."""
    place = _place(spark, "ids")
    rows = table(spark, d, "receptors").where("conformer_id IS NOT NULL AND target_id IS NOT NULL")
    rows.select(F.concat(F.lit("  "), "conformer_id", F.lit(" \t "), "target_id", F.lit("\n\n")).alias("value")).write.text(place)
    return files.read_id_list(spark, place).groupBy("structure", "id").agg(F.count("*").alias("line_count"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def fixed_width_lines(spark: SparkSession, d: str) -> DataFrame:
    """Records of fixed width among others, read by position."""
    place = _place(spark, "fixed")
    rows = table(spark, d, "customer")
    line = F.format_string("CUST  %12d%-30s%14.2f", "c_custkey", "c_name", F.col("c_acctbal").cast("double"))
    rows.select(F.explode(F.array(line, F.lit("REMARK not a record"))).alias("value")).write.text(place)
    fields = {"c_custkey": (7, 12, "bigint"), "c_name": (19, 30, "string"), "c_acctbal": (49, 14, "double")}
    return files.read_fixed_width(spark, place, fields, ("CUST",))


@query("SELECT 'nation_' || n_nationkey AS key, n_name AS value FROM nation")
def settings_lines(spark: SparkSession, d: str) -> DataFrame:
    """Settings 'key = value' with comments, read back; a missing key would be an error."""
    place = _place(spark, "settings")
    rows = table(spark, d, "nation")
    line = F.concat(F.lit(" nation_"), F.col("n_nationkey").cast("string"), F.lit(" = "), "n_name", F.lit("  # a comment"))
    rows.select(F.explode(F.array(line, F.lit("# only a comment"))).alias("value")).write.text(place)
    return files.read_settings(spark, place, required=["nation_0"])


@query("SELECT l_orderkey AS record, CAST(l_linenumber AS INTEGER) AS mode, CAST(l_quantity AS DOUBLE) AS score, CAST(l_discount AS DOUBLE) AS spread FROM lineitem")
def log_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables of modes within log texts, one log a record, read line by line."""
    place = _place(spark, "logs")
    rows = table(spark, d, "lineitem")
    line = F.format_string("record %d | %4d  %10.2f  %8.2f", "l_orderkey", F.col("l_linenumber").cast("int"), F.col("l_quantity").cast("double"), F.col("l_discount").cast("double"))
    rows.select(F.explode(F.array(F.lit("mode |   score | spread"), F.lit("-----+---------+-------"), line)).alias("value")).write.text(place)
    return files.read_log_table(spark, place, r"^record (\d+) \|\s+(\d+)\s+(-?[\d.]+)\s+(-?[\d.]+)\s*$", {"record": "bigint", "mode": "int", "score": "double", "spread": "double"})


@query("SELECT count(*) AS rows_read, count(*) FILTER (p_size > 0) AS passed FROM part")
def checked_rows(spark: SparkSession, d: str) -> DataFrame:
    """A table whose every row is held to a rule while it is read; one that broke it would fail the job."""
    rows = files.asserted(files.require_columns(table(spark, d, "part"), ["p_partkey", "p_size"]), F.col("p_size") > 0, "a size that isn't positive")
    return rows.agg(F.count("*").alias("rows_read"), F.count_if(F.col("p_size") > 0).alias("passed"))
