"""Fills, subsets, held-out fits and disturbances against plain loops on small tables."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException

from scorelake import storage
from scorelake.operators import folds, resampling, series, subsets


def filled(sizes, room, seed):
    out = []
    for g in sorted(sizes, key=lambda g: (hashlib.sha256(f"{seed}|{g}".encode()).hexdigest(), g)):
        if sizes[g] <= room:
            room -= sizes[g]
            out.append((g, sizes[g], room))
    return sorted(out)


@pytest.mark.parametrize("room", [0, 1, 7, 40, 10_000])
def test_exact_fill_is_the_loop(spark, room):
    draw = random.Random(room)
    sizes = {"s": {f"g{i}": draw.randint(1, 9) for i in range(60)}, "t": {f"h{i}": draw.choice([1, 30]) for i in range(12)}}
    rows = [(s, g) for s, every in sizes.items() for g, n in every.items() for _ in range(n)] + [("s", None)]
    got = folds.exact_fill(spark.createDataFrame(rows, "s string, g string"), ["s"], "g", room, "x").collect()
    for s, every in sizes.items():
        assert sorted((r.g, r.size, r.room_left) for r in got if r.s == s) == filled(every, room, "x")


def test_exact_fill_of_nothing(spark):
    none = folds.exact_fill(spark.createDataFrame([], "s string, g string"), ["s"], "g", 5, "x")
    assert none.columns == ["s", "g", "size", "room_left"] and none.count() == 0


def test_powerset_and_design_terms(spark, rows):
    few = spark.createDataFrame([("t", "a"), ("t", "b"), ("t", "c"), ("t", "c"), ("u", "z")], "s string, m string")
    masks = {}
    for r in subsets.powerset(few, ["s"], "m").collect():
        masks.setdefault((r.s, r["mask"]), set()).add(r.m)
    assert sorted((s, "".join(sorted(m))) for (s, _), m in masks.items()) == [("t", x) for x in ("a", "ab", "abc", "ac", "b", "bc", "c")] + [("u", "z")]
    many = spark.range(17).selectExpr("'t' AS s", "CAST(id AS STRING) AS m")
    with pytest.raises(PySparkException):
        subsets.powerset(many, ["s"], "m").collect()
    pairs = subsets.enumerate_subsets(few, ["s"], "m", 2)
    assert rows(subsets.design_terms(pairs, ["s"], 2).where("subset = 'a+c'")) == [("t", "a+c", "a"), ("t", "a+c", "a*c"), ("t", "a+c", "c")]


def test_left_out_fit_is_least_squares(spark):
    draw = np.random.default_rng(3)
    data = [(f"t{i % 4}", float(x), float(0.5 * x + e)) for i, (x, e) in enumerate(zip(draw.normal(size=80), draw.normal(size=80)))]
    df = spark.createDataFrame([*data, ("t0", None, 1.0), ("t9", 1.0, None)], "s string, x double, y double")
    got = {r.s: r for r in series.left_out_fit(df, "s", "x", "y", 0.0).collect()}
    assert sorted(got) == ["t0", "t1", "t2", "t3"]
    for s, r in got.items():
        rest, own = (np.array([(x, y) for t, x, y in data if (t == s) == mine]) for mine in (False, True))
        slope, intercept = np.polyfit(rest[:, 0], rest[:, 1], 1)
        error = np.sqrt(np.mean((own[:, 1] - intercept - slope * own[:, 0]) ** 2))
        assert np.allclose([r.slope, r.intercept, r.rmse], [slope, intercept, error]) and (r.n_held_out, r.n_fit) == (20, 60)
    alone = series.left_out_fit(spark.createDataFrame([("t", 1.0, 2.0)], "s string, x double, y double"), "s", "x", "y", 0.0).first()
    assert (alone.n_fit, alone.slope, alone.rmse) == (0, None, None)


def test_noise_moves_only_close_choices(spark):
    values = spark.createDataFrame([("far", "a", 0.0), ("far", "b", 100.0), ("near", "a", 0.0), ("near", "b", 0.001), ("near", "c", 50.0), ("near", "d", 50.001)], "s string, m string, v double")
    got = {(r.s, r.level): r for r in resampling.noisy_choice(values, ["s"], "m", "v", [0.0, 0.1], 200, "n").collect()}
    assert got["far", 0.0].share_kept == got["near", 0.0].share_kept == got["far", 0.1].share_kept == 1.0
    assert 0.35 < got["near", 0.1].share_kept < 0.65 and got["near", 0.1].different == 2 and got["near", 0.1].draws == 200


def test_neighbours_of_one_kind_are_no_chance(spark):
    ids = [("p", f"{k}{i:02}", k) for k in "ab" for i in range(20)]
    nearest = [(f"{k}{i:02}", f"{k}{(i + 1) % 20:02}") for k in "ab" for i in range(20)]
    frame = spark.createDataFrame(ids, "pool string, id string, label string")
    got = resampling.permutation_neighbours(spark.createDataFrame(nearest, "a string, b string"), frame, ["pool"], 99, "n").first()
    assert (got.ids, got.observed, got.permutations, got.p_value) == (40, 40, 99, 0.01) and 15 < got.expected < 24


def test_folder_of_a_session_without_setting(spark, monkeypatch):
    """The setting can't be changed in a running session; only local ones may go without."""

    class Bare:
        def __init__(self, master):
            self.settings = {"spark.master": master}
            self.conf, self.sparkContext = self, spark.sparkContext

        def get(self, key, default=None):
            return self.settings.get(key, default)

    monkeypatch.setattr(storage, "_own", {})
    first = storage.scratch_folder(Bare("local[4]"))
    assert first.startswith("file:") and storage.scratch_folder(Bare("local[4]")) == first
    with pytest.raises(RuntimeError):
        storage.scratch_folder(Bare("spark://host:7077"))
