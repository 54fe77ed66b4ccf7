"""Known small cases of the score operators, and of those that have no SQL counterpart."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from scorelake.operators import folds, geometry, normalize, ranking, resampling, scores, series, sets, subsets
from scorelake.operators.prefix import row_numbers, running_total


def metrics(spark, pairs, **k):
    df = spark.createDataFrame([("g", f"e{i:02d}", float(s), y) for i, (s, y) in enumerate(pairs)], "g string, entity string, score double, y int")
    return ranking.screening_metrics(df, ["g"], "score", "entity", "y", **k).first()


def test_metrics_of_a_known_ranking(spark):
    got = metrics(spark, list(zip([-11.0, -10.5, -10.0, -9.8, -9.4, -9.1, -8.7, -8.3, -8.0, -7.5], [1, 0, 1, 0, 0, 1, 0, 0, 1, 0])), fractions=(0.3,))
    assert got.roc_auc == pytest.approx(0.625) and got.ef30 == pytest.approx(1.6666666666666665) and got.average_precision == pytest.approx(0.652778, abs=1e-6) and 0 <= got.bedroc <= 1


def test_metrics_of_one_class_ties_and_nothing(spark):
    one = metrics(spark, [(-1, 1), (-2, 1)])
    assert one.roc_auc is None and one.bedroc is None and one.average_precision == 1
    tied = metrics(spark, [(-1, 1), (-1, 0), (-1, 0), (-1, 1)])
    assert tied.roc_auc == pytest.approx(0.5)
    assert metrics(spark, [(-2, 1), (-1, 0)]).bedroc == pytest.approx(1) and metrics(spark, [(-1, 1), (-2, 0)]).bedroc == pytest.approx(0)
    empty = spark.createDataFrame([], "g string, entity string, score double, y int")
    assert ranking.screening_metrics(empty, ["g"], "score", "entity", "y").count() == 0


def test_mid_rank_of_unseen_values(spark):
    train = spark.createDataFrame([("r", v) for v in (-9.0, -8.0, -7.0, -6.0)], "r string, v double")
    got = ranking.train_rank_transform(train, spark.createDataFrame([("r", v) for v in (-10.0, -8.0, -5.0)] + [("s", 1.0), ("r", None)], "r string, v double"), ["r"], "v").collect()
    assert {(x.r, x.v): x.mid_rank for x in got} == {("r", -10.0): pytest.approx(0.1), ("r", -8.0): pytest.approx(0.4), ("r", -5.0): pytest.approx(0.9), ("s", 1.0): None, ("r", None): None}


def test_scaling(spark):
    train = spark.createDataFrame([("r", -10.0), ("r", -5.0), ("c", 2.0)], "r string, v double")
    got = {(x.r, x.v): x.scaled for x in normalize.train_minmax(train, spark.createDataFrame([("r", -10.0), ("r", -5.0), ("r", -12.0), ("c", 7.0), ("z", 1.0)], "r string, v double"), ["r"], "v").collect()}
    assert got == {("r", -10.0): 0, ("r", -5.0): 1, ("r", -12.0): pytest.approx(-0.4), ("c", 7.0): 0, ("z", 1.0): None}
    terms = {x.v: (x.minmax, x.maxabs) for x in normalize.scale_terms(spark.createDataFrame([("t", -2.0), ("t", 1.0), ("t", 0.0)], "t string, v double"), ["t"], "v").collect()}
    assert terms == {-2.0: (0, -1), 1.0: (1, 0.5), 0.0: (pytest.approx(2 / 3), 0)}


def test_replicates(spark):
    cells = spark.createDataFrame([("t", s, "A", "R1", v) for s, v in (("s1", -9.0), ("s2", -9.3), ("s3", -8.8))], "target_id string, seed_id string, ligand_id string, receptor_id string, score double")
    got = scores.replicate_summary(cells).first()
    assert (got.median_score, got.minimum_score, got.best_replicate) == (-9.0, -9.3, "s2") and got.score_range == pytest.approx(0.5)


def test_latest_and_upsert(spark, rows):
    old = spark.createDataFrame([("a", 1, 5.0), ("b", 3, 6.0)], "k string, v int, x double")
    new = spark.createDataFrame([("a", 1, 7.0), ("b", 2, 8.0), ("c", None, 9.0)], "k string, v int, x double")
    assert rows(scores.upsert(old, new, ["k"], "v")) == [("a", 1, 7.0), ("b", 3, 6.0), ("c", None, 9.0)]


def test_running_totals_of_a_hot_group(spark):
    rng = random.Random(1)
    data = [("hot" if i % 3 else f"g{i % 7}", rng.random(), i, rng.choice([None, 1, 2])) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, o double, id int, w int")
    got = {r.id: r.before for r in running_total(df, ["g"], ["o", "id"], "w").collect()}
    sums = {}
    for g, _, i, w in sorted(data):
        assert got[i] == sums.get(g, 0)
        sums[g] = sums.get(g, 0) + (w or 0)
    assert sorted(r.rank for r in row_numbers(df.where("g = 'hot'"), [], ["o", "id"]).collect()) == list(range(1, 2001))
    assert row_numbers(df.limit(0), ["g"], ["o"]).count() == 0


def test_sets(spark):
    members = spark.createDataFrame([("t", "x", m) for m in "ab"] + [("t", "y", m) for m in "bc"] + [("t", "z", "d")], "t string, o string, m string")
    owners = spark.createDataFrame([("t", o) for o in "xyzvw"], "t string, o string")
    pairs = {(p.a, p.b): p.jaccard for p in sets.set_pairs(members, ["t"], "o", "m", owners).collect()}
    assert len(pairs) == 10 and pairs["x", "y"] == pytest.approx(1 / 3) and pairs["v", "w"] == 1 and pairs["x", "z"] == pairs["v", "x"] == 0
    assert len(sets.set_pairs(members, ["t"], "o", "m").collect()) == 3


def test_greedy_and_exact_subsets(spark):
    rng = random.Random(2)
    ids = list("abcdef")
    gap, pair = {i: round(rng.random(), 3) for i in ids}, {p: round(rng.random(), 3) for p in itertools.combinations(ids, 2)}
    linear = spark.createDataFrame([("t", i, v) for i, v in gap.items()], "t string, s string, gap double")
    quad = spark.createDataFrame([("t", a, b, v) for (a, b), v in pair.items()], "t string, a string, b string, agreement double")
    energy = lambda c: -sum(gap[i] for i in c) + 0.5 * sum(pair[p] for p in itertools.combinations(sorted(c), 2))
    got = {r.subset: r.energy for r in subsets.subset_energy(subsets.enumerate_subsets(linear, ["t"], "s", 3), linear, quad, ["t"], "s", 3, 0.5).collect()}
    assert got == {"+".join(c): pytest.approx(energy(c)) for c in itertools.combinations(ids, 3)}
    chosen = []
    for _ in range(3):
        chosen.append(max((i for i in ids if i not in chosen), key=lambda i: (gap[i] - 0.5 * sum(pair[tuple(sorted((i, c)))] for c in chosen), -ids.index(i))))
    assert [r.s for r in subsets.greedy_path(linear, quad, ["t"], "s", 3, 0.5).orderBy("step").collect()] == chosen


def test_maxmin(spark):
    points = {"a": 0.0, "b": 1.0, "c": 5.0, "d": 9.0}
    df = spark.createDataFrame([("p", x, y, abs(points[x] - points[y])) for x in points for y in points if x != y], "p string, a string, b string, distance double")
    assert [r.id for r in subsets.maxmin_path(df, ["p"], 3).orderBy("step").collect()] == ["a", "d", "c"]


def test_range_join_against_brute_force(spark):
    rng = random.Random(3)
    points = [(i, rng.uniform(-3, 3), rng.uniform(-3, 3), rng.uniform(-3, 3)) for i in range(200)]
    got = {(r.a, r.b) for r in geometry.within_range(spark.createDataFrame(points, "id int, x double, y double, z double"), "id", ["x", "y", "z"], 1.0).collect()}
    assert got == {(p[0], q[0]) for p, q in itertools.combinations(points, 2) if math.dist(p[1:], q[1:]) <= 1.0}


def test_folds(spark):
    df = spark.createDataFrame([(f"L{i}", i % 4 == 0, f"g{i // 5}") for i in range(200)], "id string, y boolean, g string")
    got = folds.hash_folds(df, ["y"], "id", 5, "s").groupBy("y", "fold").count().collect()
    assert {(r.y, r["count"]) for r in got} == {(True, 10), (False, 30)}
    dealt = folds.balanced_group_folds(df.withColumn("all", F.lit(1)), ["all"], "g", 4)
    sizes = [r.n for r in dealt.groupBy("fold").agg(F.sum("size").alias("n")).collect()]
    assert sum(sizes) == 200 and max(sizes) - min(sizes) <= 5
    assert folds.sample_per_stratum(df, ["y"], "g", "id", 3, "s").count() == 6
    splits = folds.stratified_split(df, ["y"], "id", 0.6, 0.2, "s").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in splits} == {"train": 120, "validation": 40, "test": 40}


def test_linked_groups(spark, rows):
    df = spark.createDataFrame([("c", "1", None), ("b", "1", "x"), ("a", None, "x"), ("d", None, None), ("e", "9", "y")], "k string, p string, q string")
    assert rows(folds.linked_groups(df, "k", ["p", "q"])) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "e")]


def test_runs_and_trend(spark):
    events = spark.createDataFrame([("u", i, i, s) for i, s in enumerate("AABBBA")], "u string, t int, id int, s string")
    got = {r.s: r for r in series.state_runs(events, "u", "t", "id", "s").collect()}
    assert (got["A"].runs, got["A"].longest_run, got["A"].occupancy, got["A"].revisited) == (2, 2, 3, True) and got["B"].revisited is False


def test_bootstrap_and_permutation_find_a_gap(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([("t", f"L{i}", int(i % 5 == 0), rng.gauss(-9 if i % 5 == 0 else -6, 0.5)) for i in range(200)], "t string, id string, y int, v double")
    boot = resampling.bootstrap_gap(df, ["t"], "id", "y", "v", 40, "s").first()
    assert boot.valid == 40 and boot.low < 3 < boot.high and boot.low > 2.5
    assert resampling.permutation_gap(df, ["t"], "id", "y", "v", 49, "s").first().p_value == pytest.approx(0.02)
    assert resampling.jackknife_gap(df, ["t"], "id", "y", "v", 5, "s").first().sign_support == 1


def test_signed_geometric_mean(spark):
    df = spark.createDataFrame([("p", 2.0), ("p", 8.0), ("n", -2.0), ("n", -8.0), ("m", -2.0), ("m", 3.0), ("z", 0.0), ("z", 1.0), ("o", -1.0), ("o", -1.0), ("o", 8.0)], "g string, v double")
    got = {r.g: r.m for r in df.groupBy("g").agg(normalize.signed_geometric_mean(F.col("v")).alias("m")).collect()}
    assert got == {"p": pytest.approx(4), "n": pytest.approx(-4), "m": None, "z": 0, "o": pytest.approx(2)}


def test_completeness_compares_the_sets(spark):
    cells = spark.createDataFrame([("t", "r", "a"), ("t", "r", "z"), ("t", "r", "z")], "target_id string, receptor_id string, ligand_id string")
    entities = spark.createDataFrame([("t", "a"), ("t", "b"), (None, "c")], "target_id string, ligand_id string")
    got = scores.completeness(cells, entities, cells).first()
    assert (got.expected, got.scored, got.missing, got.unknown) == (2, 1, 1, 1)
