"""Streams of events: windowed counts with late data, and idempotent keyed upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.operators.scores import upsert
from scorelake.storage import delete_path


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder; a single file is a stream of its own."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isFile():
        return reader.option("pathGlobFilter", path.getName()).parquet(path.getParent().toString())
    return reader.parquet(folder)


def windowed_counts(events: DataFrame, time: str, key: str, value: str, width: str, late: str) -> DataFrame:
    """(window_start, key, n, total) by tumbling windows; rows later than the watermark allows are dropped by the stream."""
    by = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key)
    return by.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")


def run_to_table(stream: DataFrame, table: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there as micro-batches into a Parquet folder, then stop; resumes from the checkpoint."""
    query = stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def _versions(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """All rows of a keyed table below ``folder`` with their bucket and version."""
    whole = T.StructType([*schema.fields, T.StructField("v", T.LongType()), T.StructField("bucket", T.IntegerType())])
    return spark.read.schema(whole).option("basePath", folder).parquet(f"{folder}/v=*")


def _held(versions: DataFrame, before: int | None = None) -> list[tuple[int, int]]:
    """(bucket, version) of all that is stored; as many as there are buckets, times the two versions kept of each."""
    rows = versions.select("bucket", "v").distinct()
    return [(r.bucket, r.v) for r in (rows if before is None else rows.where(F.col("v") < before)).collect()]


def upsert_stream(stream: DataFrame, folder: str, key: list[str], version: str, checkpoint: str, buckets: int = 64) -> None:
    """Merge a stream into a keyed table below ``folder``, bucketed by a hash of the key.

    Batch n writes the buckets it touches as version n from their last earlier version, so a
    repeated batch writes the same, and untouched buckets aren't rewritten. Of each bucket the last
    two versions are kept.
    """
    spark, schema = stream.sparkSession, stream.schema

    def merge(batch: DataFrame, number: int) -> None:
        placed = batch.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
        touched = {r.bucket for r in placed.select("bucket").distinct().collect()}
        if not touched:
            return
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
        held = [x for x in _held(_versions(spark, folder, schema), number) if x[0] in touched] if there else []
        last = {b: max(v for c, v in held if c == b) for b, _ in held}
        current = spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())]))
        if last:
            wanted = F.array(*(F.struct(F.lit(b).alias("bucket"), F.lit(v).cast("long").alias("v")) for b, v in sorted(last.items())))
            stored = _versions(spark, folder, schema).where(F.col("bucket").isin(*last) & F.col("v").isin(*set(last.values())))
            current = stored.where(F.array_contains(wanted, F.struct("bucket", "v"))).drop("v")
        merged = upsert(current, placed, ["bucket", *key], version)
        merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/v={number}")
        for bucket, old in held:
            if old < last[bucket]:
                delete_path(spark, f"{folder}/v={old}/bucket={bucket}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def complete_counts(stream: DataFrame, time: str, key: str, width: str, folder: str, checkpoint: str) -> DataFrame:
    """(window_start, key, n) over everything streamed so far; every batch writes the whole result anew, so a repeated batch does no harm."""
    spark = stream.sparkSession
    counted = stream.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(folder)

    counted.writeStream.outputMode("complete").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counted.schema).parquet(folder)


def latest_version(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The keyed table that ``upsert_stream`` wrote: of each bucket the last version."""
    versions = _versions(spark, folder, schema)
    last: dict[int, int] = {}
    for bucket, v in _held(versions):
        last[bucket] = max(v, last.get(bucket, v))
    wanted = F.array(*(F.struct(F.lit(b).alias("bucket"), F.lit(v).cast("long").alias("v")) for b, v in sorted(last.items())))
    return versions.where(F.array_contains(wanted, F.struct("bucket", "v")) if last else F.lit(False)).drop("v", "bucket")
