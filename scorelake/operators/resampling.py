"""Bootstrap, jackknife and permutation with draws derived from hashes, so that results don't depend on partitions.

Rows are reduced to one per entity first; replicates multiply those, never the raw facts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.operators.prefix import row_numbers
from scorelake.storage import materialize


def uniform(seed: str, *parts: str) -> Column:
    """In [0, 1), from the first 48 bits of a SHA-256 of seed|part|part..."""
    text = F.concat_ws("|", F.lit(seed), *(F.col(p).cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("double") / float(1 << 48)


def poisson_weight(u: Column) -> Column:
    """Poisson(1) count of a uniform number: how often a row is drawn in a bootstrap."""
    out, total, term = F.lit(8), 0.0, 0.36787944117144233
    bounds = []
    for k in range(8):
        total += term
        bounds.append((k, total))
        term /= k + 1
    for k, bound in reversed(bounds):
        out = F.when(u < bound, k).otherwise(out)
    return out


def bootstrap_gap(df: DataFrame, scope: list[str], unit: str, y: str, value: str, replicates: int, seed: str) -> DataFrame:
    """Per scope: mean and 95 % interval of mean(value of y=0) - mean(value of y=1) over bootstrap replicates of whole units.

    Replicates without one of the classes are left out and counted.
    """
    rows = df.groupBy(*scope, unit, y).agg(F.sum(value).alias("s"), F.count(value).alias("n")).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    drawn = rows.withColumn("w", poisson_weight(uniform(seed, "replicate", unit)))
    side = lambda v: F.try_divide(F.sum(F.when(F.col(y) == v, F.col("w") * F.col("s"))), F.sum(F.when(F.col(y) == v, F.col("w") * F.col("n"))))
    gaps = drawn.groupBy(*scope, "replicate").agg((side(0) - side(1)).alias("gap"))
    return gaps.groupBy(*scope).agg(F.count("gap").alias("valid"), F.avg("gap").alias("mean_gap"), F.percentile("gap", 0.025).alias("low"), F.percentile("gap", 0.975).alias("high"))


def jackknife_gap(df: DataFrame, scope: list[str], unit: str, y: str, value: str, blocks: int, seed: str) -> DataFrame:
    """Per scope: gap over all rows, median of the delete-one-block gaps, their median absolute deviation, share with the sign of the whole."""
    block = F.floor(uniform(seed, unit) * blocks).cast("int")
    sums = df.groupBy(*scope, block.alias("block"), y).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    wide = sums.groupBy(*scope, "block").agg(*(F.coalesce(F.sum(F.when(F.col(y) == v, F.col(c))), F.lit(0)).alias(f"{c}{v}") for v in (0, 1) for c in ("s", "n")))
    total = wide.groupBy(*scope).agg(*(F.sum(c).alias(f"t_{c}") for c in ("s0", "n0", "s1", "n1")))
    gap = lambda s0, n0, s1, n1: F.try_divide(s0, n0) - F.try_divide(s1, n1)
    c = F.col
    each = wide.join(total, scope).select(*scope, gap(c("t_s0"), c("t_n0"), c("t_s1"), c("t_n1")).alias("gap"), gap(c("t_s0") - c("s0"), c("t_n0") - c("n0"), c("t_s1") - c("s1"), c("t_n1") - c("n1")).alias("part"))
    middle = each.groupBy(*scope).agg(F.median("part").alias("median_part"))
    return each.join(middle, scope).groupBy(*scope).agg(F.first("gap").alias("gap"), F.first("median_part").alias("median_part"), F.median(F.abs(c("part") - c("median_part"))).alias("mad"), F.avg((F.signum("part") == F.signum("gap")).cast("double")).alias("sign_support"))


def permutation_gap(df: DataFrame, scope: list[str], unit: str, y: str, value: str, replicates: int, seed: str) -> DataFrame:
    """Per scope: gap between the classes' means and p = (1 + permutations at least as large) / (1 + permutations).

    A permutation gives the p units that come first in its hash order the label 1; the orders are
    running totals over range-partitioned rows, so a scope with many units is spread.
    """
    units = df.groupBy(*scope, unit, y).agg(F.avg(value).alias("v"))
    whole = units.groupBy(*scope).agg(F.sum(y).alias("p"), (F.avg(F.when(F.col(y) == 0, F.col("v"))) - F.avg(F.when(F.col(y) == 1, F.col("v")))).alias("gap"))
    rows = units.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("u", uniform(seed, "replicate", unit))
    placed = row_numbers(rows.select(*scope, "replicate", "u", unit, "v"), [*scope, "replicate"], ["u", unit], "r").join(whole.select(*scope, "p"), scope)
    gaps = placed.groupBy(*scope, "replicate").agg((F.avg(F.when(F.col("r") > F.col("p"), F.col("v"))) - F.avg(F.when(F.col("r") <= F.col("p"), F.col("v")))).alias("g"))
    return gaps.join(whole, scope).groupBy(*scope).agg(F.first("gap").alias("gap"), F.count("g").alias("permutations"), ((1 + F.count_if(F.col("g") >= F.col("gap") - 1e-9)) / (1 + F.count("g"))).alias("p_value"))


def permutation_neighbours(nearest: DataFrame, ids: DataFrame, scope: list[str], replicates: int, seed: str) -> DataFrame:
    """Per scope: ids whose nearest other id has their label, and p = (1 + permutations with at least as many) / (1 + permutations).

    ``nearest``: a, b; ``ids``: scope, id, label. A permutation gives the id at a place of its hash
    order the label of the id at that place of the id order; both orders are running totals.
    """
    placed = materialize(row_numbers(ids.select(*scope, "id", "label"), scope, ["id"], "r"), "placed")
    drawn = placed.select(*scope, "id").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("u", uniform(seed, "replicate", "id"))
    moved = row_numbers(drawn, [*scope, "replicate"], ["u", "id"], "r").join(placed.select(*scope, "r", "label"), [*scope, "r"]).select(*scope, "id", "replicate", "label")
    given = materialize(moved.unionByName(placed.select(*scope, "id", F.lit(-1).alias("replicate"), "label")), "given")
    other = given.select(F.col("id").alias("b"), "replicate", F.col("label").alias("other"))
    both = given.join(nearest.select(F.col("a").alias("id"), "b"), "id").join(other, ["b", "replicate"])
    each = both.groupBy(*scope, "replicate").agg(F.count("*").alias("ids"), F.count_if(F.col("label") == F.col("other")).alias("same"))
    real = each.where("replicate = -1").select(*scope, "ids", F.col("same").alias("observed"))
    against = each.where("replicate >= 0").join(real.select(*scope, "observed"), scope).groupBy(*scope).agg(F.count("*").alias("permutations"), F.avg("same").alias("expected"), F.count_if(F.col("same") >= F.col("observed")).alias("__ge"))
    return real.join(against, scope).select(*scope, "ids", "observed", "expected", "permutations", ((1 + F.col("__ge")) / (1 + F.col("permutations"))).alias("p_value"))


def noisy_choice(values: DataFrame, scope: list[str], member: str, value: str, levels: list[float], draws: int, seed: str) -> DataFrame:
    """Per scope and level: how often the member of the greatest value stays so when every value gets normal noise of ``level`` standard deviations of the scope's values.

    One row per member, level and draw; noise comes from hashes of draw, scope and member.
    """
    spread = values.groupBy(*scope).agg(F.stddev_pop(value).alias("__sd"), F.max(F.struct(F.col(value).alias("v"), F.col(member).alias("m"))).alias("__best"))
    wide = values.join(spread, scope).withColumn("level", F.explode(F.array(*(F.lit(float(x)) for x in levels)))).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u, w = uniform(f"{seed}1", "draw", *scope, member), uniform(f"{seed}2", "draw", *scope, member)
    normal = F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * w)
    noisy = wide.withColumn("__v", F.col(value) + F.col("level") * F.col("__sd") * normal)
    best = noisy.groupBy(*scope, "level", "draw").agg(F.max(F.struct(F.col("__v").alias("v"), F.col(member).alias("m")))["m"].alias("found"), F.first("__best")["m"].alias("best"))
    return best.groupBy(*scope, "level").agg(F.first("best").alias("best"), F.count("*").alias("draws"), F.countDistinct("found").alias("different"), F.avg((F.col("found") == F.col("best")).cast("double")).alias("share_kept"))
