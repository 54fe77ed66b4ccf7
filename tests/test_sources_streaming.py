from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from scorelake.operators.scores import latest_rows
from scorelake.sources import files
from scorelake.streaming import events


def test_text_sources(spark, tmp_path):
    (tmp_path / "ids.ism").write_text("CCO  L1\n\nCC L2 extra\nlone\n")
    assert [(r.structure, r.id) for r in files.read_id_list(spark, f"{tmp_path}/ids.ism").orderBy("id").collect()] == [("CCO", "L1"), ("CC", "L2")]
    (tmp_path / "a.pdb").write_text("HEADER\nATOM      1  N   ALA A  12      11.104   6.134  -6.504\nATOM      2  CA  ALA A  13      xx.104   6.134  -6.504\n")
    got = files.read_fixed_width(spark, f"{tmp_path}/a.pdb", {"name": (13, 4, "string"), "residue": (23, 4, "int"), "x": (31, 8, "double")}, ("ATOM", "HETATM")).collect()
    assert [tuple(r) for r in got] == [("N", 12, 11.104), ("CA", 13, None)]
    (tmp_path / "c.txt").write_text("# note\nexhaustiveness = 32  # more\nname = a = b\n\n")
    assert {r.key: r.value for r in files.read_settings(spark, f"{tmp_path}/c.txt").collect()} == {"exhaustiveness": "32", "name": "a = b"}
    assert files.file_digests(spark, f"{tmp_path}/c.txt").first().sha256 == hashlib.sha256((tmp_path / "c.txt").read_bytes()).hexdigest()


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("target_id,score\nt,-1.5\n")
    (tmp_path / "b.csv").write_text("score,target_id,extra\n,u,x\n")
    rows = files.read_score_files(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"], ["target_id", "score"])
    assert {(r.target_id, r.score, r.extra) for r in rows.collect()} == {("t", "-1.5", None), ("u", None, "x")}
    with pytest.raises(ValueError, match="missing columns: label"):
        files.read_score_files(spark, [f"{tmp_path}/a.csv"], ["label"])
    files.write_csv([rows.drop("source_file"), spark.createDataFrame([("v", "q")], "target_id string, more string")], f"{tmp_path}/out")
    assert spark.read.csv(f"{tmp_path}/out", header=True).columns == ["target_id", "score", "extra", "more"]
    with pytest.raises(Exception, match="positive"):
        files.asserted(rows, F.col("score").cast("double") > 0, "positive scores only").collect()


def test_windowed_stream_equals_batch(spark, folder, tmp_path):
    source = spark.read.parquet(f"{folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source.repartitionByRange(3, "ts").write.parquet(f"{tmp_path}/in")
    stream = events.read_stream(spark, f"{tmp_path}/in", source.schema, 10)
    counted = events.windowed_counts(stream, "ts", "event_type", "value", "1 day", "10 days")
    events.run_to_table(counted, f"{tmp_path}/out", f"{tmp_path}/check")
    got = {(r.window_start, r.event_type): r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.w.start, r.event_type): r["count"] for r in source.groupBy(F.window("ts", "1 day").alias("w"), "event_type").count().collect()}
    assert got.items() <= want.items() and len(got) > 0  # windows behind the watermark are out


def test_upsert_stream(spark, folder, tmp_path):
    key = ["target_id", "seed_id", "ligand_id", "receptor_id"]
    rows = spark.read.parquet(f"{folder}/seed_scores.parquet").drop("scored_at")
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    events.upsert_stream(events.read_stream(spark, f"{tmp_path}/in", rows.schema), f"{tmp_path}/t", key, "loaded_at", f"{tmp_path}/c")
    last = spark.read.parquet(f"{tmp_path}/t/v=3")
    batch = latest_rows(rows, key, "loaded_at")
    assert last.count() == batch.count() and last.select(*key, "loaded_at").exceptAll(batch.select(*key, "loaded_at")).count() == 0


def test_upserts_rewrite_touched_buckets_only(spark, tmp_path):
    schema = "k string, n long, x double"
    stored = str(tmp_path / "keyed")
    for turn, rows in enumerate(([(f"k{i}", 1, float(i)) for i in range(200)], [("k7", 2, 70.0), ("k8", 0, 80.0)], [("k7", 3, 71.0), ("new", 1, 1.0)], [("k7", 4, 72.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = events.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 10)
        events.upsert_stream(stream, stored, ["k"], "n", str(tmp_path / "checkpoint"), buckets=16)
    got = {r.k: (r.n, r.x) for r in events.latest_version(spark, stored, stream.schema).collect()}
    assert len(got) == 201 and got["k7"] == (4, 72.0) and got["k8"] == (1, 8.0) and got["new"] == (1, 1.0)
    folders = [p.parent.name for p in (tmp_path / "keyed").glob("v=*/bucket=*")]
    assert folders.count("v=3") == 1 and folders.count("v=1") <= 2
