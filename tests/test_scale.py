"""Groups that hold nine tenths of the rows, and what the session leaves behind."""

from __future__ import annotations

import math
import random

import pytest

import __spark_entry__ as entry
from scorelake import storage
from scorelake.operators import geometry, prefix, resampling, utilities


def test_permutations_of_a_hot_scope(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 10 else "cold", f"L{i}", int(i % 4 == 0), rng.gauss(-8 if i % 4 == 0 else -6, 1)) for i in range(2000)]
    got = {r.t: r for r in resampling.permutation_gap(spark.createDataFrame(rows, "t string, id string, y int, v double"), ["t"], "id", "y", "v", 19, "s").collect()}
    assert got["hot"].permutations == 19 and got["hot"].p_value == pytest.approx(0.05)


def test_range_join_of_a_dense_cell(spark, monkeypatch):
    monkeypatch.setattr(geometry, "BLOCK", 32)
    rng = random.Random(6)
    points = [(i, [rng.uniform(0, 0.3) if i % 10 else rng.uniform(-3, 3) for _ in range(3)]) for i in range(400)] + [(1000, None)]
    got = {(r.a, r.b) for r in geometry.vectors_within(spark.createDataFrame(points, "id int, v array<double>"), "id", "v", 0.2).collect()}
    whole = [p for p in points if p[1]]
    assert got == {(p[0], q[0]) for p in whole for q in whole if p[0] < q[0] and math.dist(p[1], q[1]) <= 0.2}
    assert geometry.vectors_within(spark.createDataFrame([], "id int, v array<double>"), "id", "v", 1.0).count() == 0


def broadcast_rows(node):
    """Rows of every broadcast of an executed plan."""
    name, own = node.nodeName(), []
    if name == "BroadcastExchange":
        own = [node.metrics().apply("numOutputRows").value()]
    inner = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if name.endswith("QueryStage") else []
    below = node.children()
    return own + [n for x in [*inner, *(below.apply(i) for i in range(below.size()))] for n in broadcast_rows(x)]


def test_range_contacts_broadcasts_no_points(spark, folder):
    points = spark.read.parquet(f"{folder}/conformers.parquet").where("size(pocket_features) >= 3").select("conformer_id").distinct().count()
    df = entry.queries()["range_contacts"](spark, folder)
    assert df.collect()
    assert all(n < points for n in broadcast_rows(df._jdf.queryExecution().executedPlan()))


def test_range_pairs_broadcasts_no_points(spark, folder):
    points = spark.read.parquet(f"{folder}/conformers.parquet").where("size(pocket_features) >= 3").select("conformer_id").distinct().count()
    df = entry.queries()["range_pairs"](spark, folder)
    assert df.collect()
    assert all(n < points for n in broadcast_rows(df._jdf.queryExecution().executedPlan()))


def test_range_join_of_vectors_shorter_than_the_grid(spark):
    rng = random.Random(10)
    points = [(f"p{i}", [rng.uniform(-1, 1) for _ in range(2)]) for i in range(80)]
    got = sorted((r.a, r.b) for r in geometry.vectors_within(spark.createDataFrame(points, "id string, v array<double>"), "id", "v", 0.25).collect())
    assert got == sorted((p[0], q[0]) for p in points for q in points if p[0] < q[0] and math.dist(p[1], q[1]) <= 0.25)


def test_carried_columns_of_a_range_join(spark, monkeypatch):
    monkeypatch.setattr(geometry, "BLOCK", 8)
    rng = random.Random(9)
    points = [(f"p{i}", f"g{i % 3}", [rng.gauss(0, 0.5) for _ in range(3)]) for i in range(150)]
    df = spark.createDataFrame(points, "id string, g string, v array<double>")
    got = sorted((r.a, r.b, r.g_a, r.g_b) for r in geometry.vectors_within(df, "id", "v", 0.3, carried=["g"]).collect())
    assert got == sorted((p[0], q[0], p[1], q[1]) for p in points for q in points if p[0] < q[0] and math.dist(p[2], q[2]) <= 0.3)


def test_carried_values_of_a_hot_group(spark):
    rng = random.Random(7)
    rows = [("hot" if i % 10 else None, rng.random(), i, f"v{i}" if rng.random() < 0.01 else None) for i in range(3000)]
    got = {r.id: r.last for r in prefix.carried_values(spark.createDataFrame(rows, "g string, o double, id int, c string"), ["g"], ["o", "id"], {"last": "c"}).collect()}
    last = {}
    for g, _, i, c in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        last[g] = c or last.get(g)
        assert got[i] == last[g]


def test_bootstrap_draws_against_brute_force(spark):
    rng = random.Random(8)
    rows = [("t", f"g{i % 7}", f"L{i}", round(rng.gauss(-7, 1), 1), int(rng.random() < 0.3)) for i in range(60)]
    df = spark.createDataFrame(rows, "t string, u string, id string, s double, y int")
    draws = {r.replicate: r for r in utilities.bootstrap_metrics(df, ["t"], "u", "id", "s", "y", 12, "seed").collect()}
    weights = {(r.replicate, r.u): r.w for r in df.selectExpr("u", "explode(sequence(0, 11)) AS replicate").distinct().withColumn("w", resampling.poisson_weight(resampling.uniform("seed", "replicate", "u"))).collect()}
    for k in range(12):
        order = [(s, y) for _, u, i, s, y in sorted(rows, key=lambda r: (r[3], r[2])) for _ in range(weights[k, u])]
        a, n = sum(y for _, y in order), len(order)
        won = sum((s < t) + (s == t) / 2 for s, y in order if y for t, z in order if not z)
        assert draws[k].roc_auc == pytest.approx(won / (a * (n - a)))
        seen, ap = 0, 0.0
        for r, (_, y) in enumerate(order, 1):
            seen += y
            ap += y * seen / r
        assert draws[k].average_precision == pytest.approx(ap / a)


def test_scratch_leaves_nothing(spark):
    kept = list(storage._written)
    with storage.scratch():
        stored = storage.materialize(spark.range(5), "some")
        path = storage._written[-1][1]
        assert stored.count() == 5
    assert storage._written == kept
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
