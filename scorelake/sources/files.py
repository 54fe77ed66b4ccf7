"""File sources and sinks besides Parquet, and assertions on what was read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The table itself, or an error that names what is missing; at analysis time, without a job."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_score_files(spark: SparkSession, paths: list[str], required: list[str]) -> DataFrame:
    """CSV score files with a header each, as text columns; files may order or extend their columns differently. Adds source_file."""
    tables = [require_columns(spark.read.csv(p, header=True, inferSchema=False), required).withColumn("source_file", F.col("_metadata.file_path")) for p in paths]
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with an explicit schema; rows that don't fit it fail the read, and so does a table without rows."""
    rows = spark.read.csv(path, header=True, schema=schema, mode="FAILFAST")
    if rows.isEmpty():
        raise ValueError(f"no rows in {path}")
    return rows


def write_csv(tables: list[DataFrame], path: str) -> None:
    """Union of tables by name, columns in first-seen order, as CSV with a header."""
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    out.write.mode("overwrite").csv(path, header=True)


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """(structure, id): lines of at least two fields separated by blanks; blank lines are skipped."""
    fields = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(fields) >= 2).select(fields[0].alias("structure"), fields[1].alias("id"))


def read_fixed_width(spark: SparkSession, path: str, fields: dict[str, tuple[int, int, str]], kinds: tuple[str, ...]) -> DataFrame:
    """Records of fixed width whose first six characters are one of ``kinds``; fields: name -> (start, length, type), unreadable values null."""
    rows = spark.read.text(path).where(F.trim(F.substring("value", 1, 6)).isin(*kinds))
    return rows.select(*(F.trim(F.substring("value", a, n)).try_cast(t).alias(name) for name, (a, n, t) in fields.items()))


def read_settings(spark: SparkSession, path: str, required: list[str] | None = None) -> DataFrame:
    """(key, value) of lines 'key = value'; '#' starts a comment. ``required`` keys that are missing are an error."""
    line = F.trim(F.split("value", "#")[0])
    parts = F.split(line, "=", 2)
    found = spark.read.text(path).where(F.size(parts) == 2).select(F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("value"))
    if required:
        have = {r[0] for r in found.where(F.col("key").isin(*required)).select("key").distinct().collect()}
        if missing := [k for k in required if k not in have]:
            raise ValueError(f"missing settings: {', '.join(missing)}")
    return found


def read_log_table(spark: SparkSession, path: str, pattern: str, fields: dict[str, str]) -> DataFrame:
    """The lines of log texts that match ``pattern``, its groups as the ``fields`` (name -> type) in order; unreadable values are null."""
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    return lines.select(*(F.regexp_extract("value", pattern, i).try_cast(t).alias(name) for i, (name, t) in enumerate(fields.items(), 1)))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def asserted(df: DataFrame, check: Column, message: str) -> DataFrame:
    """The table; a row that breaks the check fails the job with the message."""
    return df.where(F.coalesce(F.assert_true(check, message).cast("string"), F.lit("")) == "")
