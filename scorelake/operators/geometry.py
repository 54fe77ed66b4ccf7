"""Pair tables, neighbours, medoids, silhouettes and range joins."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.storage import materialize


def clean_pairs(pairs: DataFrame, a: str, b: str, distance: str) -> DataFrame:
    """(a, b, distance) with a < b, each pair once (its least distance); self pairs, nulls and NaN left out."""
    good = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)) & F.col(distance).isNotNull() & ~F.isnan(distance)
    return pairs.where(good).groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.min(distance).alias("distance"))


def pair_audit(pairs: DataFrame, a: str, b: str, distance: str) -> DataFrame:
    """One row: rows, self pairs, missing distances, different pairs, repeated pairs."""
    key = F.when(F.col(a) != F.col(b), F.struct(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")))
    missing = F.col(distance).isNull() | F.isnan(distance)
    each = pairs.groupBy(key.alias("k")).agg(F.count("*").alias("n"), F.count_if(missing).alias("missing"))
    pair = F.col("k").isNotNull()
    return each.agg(F.sum("n").alias("row_count"), F.sum(F.when(pair, 0).otherwise(F.col("n"))).alias("self_pairs"), F.sum("missing").alias("missing_distances"), F.count_if(pair).alias("pairs"), F.count_if(pair & (F.col("n") > 1)).alias("repeated_pairs"))


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b", "distance").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))


def medoids(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, medoid, mean_distance): per cluster the member with the least mean distance to the others."""
    inside = both_ways(pairs).join(members.select(F.col("id").alias("a"), F.col("cluster")), "a").join(members.select(F.col("id").alias("b"), F.col("cluster").alias("other")), "b").where("cluster = other")
    sums = inside.groupBy("cluster", "a").agg(F.avg("distance").alias("mean_distance"))
    best = sums.groupBy("cluster").agg(F.min(F.struct(F.round("mean_distance", 9).alias("m"), F.col("a").alias("a"))).alias("b"))
    return best.select("cluster", F.col("b.a").alias("medoid"), F.col("b.m").alias("mean_distance"))


def silhouettes(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id, cluster, silhouette): (b - a) / max(a, b) from mean distances; 0 for a single member, null without another cluster."""
    far = both_ways(pairs).join(members.select(F.col("id").alias("b"), F.col("cluster").alias("other")), "b").groupBy("a", "other").agg(F.avg("distance").alias("mean"))
    own = members.join(far, members["id"] == far["a"]).groupBy("id", "cluster").agg(F.max(F.when(F.col("other") == F.col("cluster"), F.col("mean"))).alias("x"), F.min(F.when(F.col("other") != F.col("cluster"), F.col("mean"))).alias("y"))
    return own.select("id", "cluster", F.when(F.col("x").isNull(), 0.0).otherwise(F.try_divide(F.col("y") - F.col("x"), F.greatest("x", "y"))).alias("silhouette"))


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """(a, b, distance, rank): the k nearest of every id, ties by id; ranks cut early, before the shuffle."""
    order = Window.partitionBy("a").orderBy("distance", "b")
    return both_ways(pairs).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Points of one cell that one task pairs at a time.
BLOCK = 512


def within_range(points: DataFrame, key: str, coordinates: list[str], cutoff: float) -> DataFrame:
    """(a, b, distance) of points at most ``cutoff`` apart, a before b; ``vectors_within`` over named coordinates. Points with a null coordinate have no partner."""
    whole = points.dropna(subset=coordinates)
    return vectors_within(whole.select(key, F.array(*(F.col(c).cast("double") for c in coordinates)).alias("point")), key, "point", cutoff, coordinates=len(coordinates))


def vectors_within(points: DataFrame, key: str, vector: str, cutoff: float, coordinates: int = 3, carried: Sequence[str] = ()) -> DataFrame:
    """(a, b, distance) of different vectors of one length at most ``cutoff`` apart, a before b, with ``x_a`` and ``x_b`` of every column x of ``carried``.

    A join of grid cells over the first ``coordinates`` of each vector, in which near vectors are
    near as well; each meets its own and half of the neighbouring cells, as the others meet it, and
    the distance is that of whole vectors. Cells with many points are cut into blocks that different
    tasks pair; only the table of these cells may be broadcast. Null vectors have no partner.

    Spark takes exploded rows to be as large as those they come from, so by its own choice it would
    broadcast all neighbouring cells: the sides are merged.
    """
    cell = F.transform(F.slice(vector, 1, coordinates), lambda x: F.floor(x / cutoff).cast("long"))
    rows = materialize(points.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v"), *carried, cell.alias("cell")), "points")
    crowded = materialize(rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1"), "crowded")
    blocks = F.coalesce("blocks", F.lit(1))
    left = rows.join(crowded, "cell", "left").select(F.col("id").alias("a"), F.col("v").alias("va"), *(F.col(c).alias(f"{c}_a") for c in carried), "cell", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))
    steps = F.array(*(F.array(*map(F.lit, s)) for s in itertools.product((-1, 0, 1), repeat=coordinates) if s >= (0,) * coordinates))
    cells = F.array_distinct(F.transform(steps, lambda s: F.slice(F.zip_with("cell", s, lambda x, y: x + y), 1, F.size("cell"))))
    near = rows.select(F.col("id").alias("b"), F.col("v").alias("vb"), *(F.col(c).alias(f"{c}_b") for c in carried), F.col("cell").alias("home"), F.explode(cells).alias("cell"))
    right = near.join(crowded, "cell", "left").select("b", "vb", *(f"{c}_b" for c in carried), "cell", (F.col("cell") == F.col("home")).alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    # The first squares are compiled, unlike the sum over whole vectors; they leave out only what is too far in any case.
    apart = [F.get("va", F.lit(i)) - F.get("vb", F.lit(i)) for i in range(coordinates)]
    within = F.coalesce(functools.reduce(Column.__add__, (x * x for x in apart)) <= cutoff * cutoff * (1 + 1e-9), F.lit(True))
    once = F.when(F.col("own"), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b"))
    square = F.aggregate(F.zip_with("va", "vb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    pairs = left.join(right.hint("merge"), ["cell", "block"]).where(once & within).withColumn("distance", F.sqrt(square)).where(F.col("distance") <= cutoff)
    end = lambda x, y: F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y)).alias(x)
    return pairs.select(end("a", "b"), end("b", "a"), *(end(f"{c}_{x}", f"{c}_{y}") for c in carried for x, y in ("ab", "ba")), "distance")


def successor_basins(pairs: DataFrame, quality: DataFrame, rounds: int = 30) -> DataFrame:
    """(id, successor, endpoint): every id goes to its nearest neighbour of strictly better (lower) quality; chains are followed by pointer doubling."""
    q = quality.where("quality IS NOT NULL")
    steps = both_ways(pairs).join(q.select(F.col("id").alias("a"), F.col("quality").alias("qa")), "a").join(q.select(F.col("id").alias("b"), F.col("quality").alias("qb")), "b").where("qb < qa")
    best = steps.groupBy("a").agg(F.min(F.struct("distance", "b"))["b"].alias("successor"))
    moves = materialize(q.select("id").join(best, q["id"] == best["a"], "left").select("id", F.coalesce("successor", "id").alias("successor")), "moves")
    ends = moves.select("id", F.col("successor").alias("endpoint"))
    for _ in range(rounds):
        ahead = ends.select(F.col("id").alias("endpoint"), F.col("endpoint").alias("further"))
        following = materialize(ends.join(ahead, "endpoint").select("id", F.col("endpoint").alias("old"), F.col("further").alias("endpoint")), "ends")
        ends = following.select("id", "endpoint")
        if following.where("old <> endpoint").isEmpty():
            break
    return moves.join(ends, "id")


def superposed_rmsd(points: DataFrame, reference: DataFrame) -> DataFrame:
    """(id, direct_rmsd, fitted_rmsd): root mean square distance of 3-D points to those of the group's reference, as they stand and after the best rotation.

    ``points``: id, grp, xyz (flat list of coordinates); ``reference``: grp, ref. The rotation is a
    small singular value decomposition, done for all rows of an Arrow batch at once.
    """
    def run(frames):
        for f in frames:
            if not len(f):
                continue
            a = np.stack([np.asarray(x, float).reshape(-1, 3) for x in f.xyz])
            b = np.stack([np.asarray(x, float).reshape(-1, 3) for x in f.ref])
            direct = np.sqrt(((a - b) ** 2).sum((1, 2)) / a.shape[1])
            a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
            u, s, vt = np.linalg.svd(np.einsum("nij,nik->njk", a, b))
            s[:, -1] *= np.sign(np.linalg.det(u) * np.linalg.det(vt))
            rest = (a**2).sum((1, 2)) + (b**2).sum((1, 2)) - 2 * s.sum(1)
            yield pd.DataFrame({"id": f.id, "direct_rmsd": direct, "fitted_rmsd": np.sqrt(np.maximum(rest, 0) / a.shape[1])})

    joined = points.join(reference, "grp").where(F.size("xyz") == F.size("ref")).where(F.size("xyz") % 3 == 0).select("id", "xyz", "ref")
    return joined.mapInPandas(run, "id string, direct_rmsd double, fitted_rmsd double")
