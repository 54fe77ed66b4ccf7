"""Scorer subsets: enumeration, coefficients, exact and greedy choice.

Enumeration joins members in increasing order, so a scope with m members gives C(m, k) rows of a
fixed small m; what is summed over entities is aggregated to pairs of members before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelake.storage import materialize


def enumerate_subsets(members: DataFrame, scope: list[str], member: str, size: int) -> DataFrame:
    """All subsets of ``size`` members per scope, as m1 < m2 < ... and ``subset`` joined by '+'."""
    once = materialize(members.select(*scope, member).distinct(), "members")
    out = once.select(*scope, F.col(member).alias("m1"))
    for k in range(2, size + 1):
        more = once.select(*scope, F.col(member).alias(f"m{k}"))
        out = out.join(more, scope).where(F.col(f"m{k - 1}") < F.col(f"m{k}"))
    return out.withColumn("subset", F.concat_ws("+", *(f"m{k}" for k in range(1, size + 1))))


def powerset(members: DataFrame, scope: list[str], member: str, most: int = 16) -> DataFrame:
    """(scope, mask, member): every non-empty subset of a chosen few members, as one row per subset and member; an error where a scope has more than ``most``."""
    held = members.groupBy(*scope).agg(F.sort_array(F.collect_set(member)).alias("__all"))  # chosen members only, see ``most``
    n = F.size("__all")
    few = held.where(F.coalesce(F.assert_true(n <= most, F.lit(f"more than {most} members for all subsets")).cast("string"), F.lit("")) == "")
    masks = few.withColumn("mask", F.explode(F.expr("sequence(1, shiftleft(1, size(__all)) - 1)")))
    return masks.select(*scope, "mask", F.posexplode("__all").alias("__i", member)).where(F.expr("shiftright(mask, __i) & 1 = 1")).drop("__i")


def design_terms(subsets: DataFrame, scope: list[str], size: int) -> DataFrame:
    """(scope, subset, term): the terms that are 1 for a subset, its members and their pairs; a sparse design matrix of any width."""
    single = [F.col(f"m{k}") for k in range(1, size + 1)]
    double = [F.concat_ws("*", f"m{i}", f"m{j}") for i in range(1, size + 1) for j in range(i + 1, size + 1)]
    return subsets.select(*scope, "subset", F.explode(F.array(*single, *double)).alias("term"))


def coefficients(scores: DataFrame, scope: list[str], scorer: str, entity: str, score: str, y: str) -> tuple[DataFrame, DataFrame]:
    """Linear (scorer: class gap of the mean score) and quadratic (pair: share of common entities on which both agree in sign about their mean) coefficients."""
    means = scores.groupBy(*scope, scorer).agg(F.avg(score).alias("mean"), (F.avg(F.when(F.col(y) == 0, F.col(score))) - F.avg(F.when(F.col(y) == 1, F.col(score)))).alias("gap"))
    signs = scores.join(means.select(*scope, scorer, "mean"), [*scope, scorer]).select(*scope, scorer, entity, (F.col(score) < F.col("mean")).alias("low"))
    a = signs.withColumnRenamed(scorer, "a").withColumnRenamed("low", "low_a")
    b = signs.withColumnRenamed(scorer, "b").withColumnRenamed("low", "low_b")
    pairs = a.join(b, [*scope, entity]).where("a < b").groupBy(*scope, "a", "b").agg(F.avg((F.col("low_a") == F.col("low_b")).cast("double")).alias("agreement"), F.count("*").alias("common"))
    return means.select(*scope, scorer, F.coalesce("gap", F.lit(0.0)).alias("gap")), pairs


def subset_energy(subsets: DataFrame, linear: DataFrame, pairs: DataFrame, scope: list[str], scorer: str, size: int, redundancy: float) -> DataFrame:
    """energy = -sum of gaps + redundancy * sum of pair agreements, per subset; the least is best."""
    energy = F.lit(0.0)
    rows = subsets
    for k in range(1, size + 1):
        rows = rows.join(linear.select(*scope, F.col(scorer).alias(f"m{k}"), F.col("gap").alias(f"g{k}")), [*scope, f"m{k}"])
        energy = energy - F.col(f"g{k}")
    for i in range(1, size + 1):
        for j in range(i + 1, size + 1):
            rows = rows.join(pairs.select(*scope, F.col("a").alias(f"m{i}"), F.col("b").alias(f"m{j}"), F.col("agreement").alias(f"p{i}{j}")), [*scope, f"m{i}", f"m{j}"], "left")
            energy = energy + redundancy * F.coalesce(F.col(f"p{i}{j}"), F.lit(0.0))
    return rows.select(*scope, "subset", energy.alias("energy"))


def greedy_path(linear: DataFrame, pairs: DataFrame, scope: list[str], scorer: str, steps: int, redundancy: float) -> DataFrame:
    """(scope, step, scorer, gain): forward greedy, one join and aggregate per step for all scopes at once."""
    both = pairs.select(*scope, "a", "b", "agreement").unionAll(pairs.select(*scope, F.col("b").alias("a"), F.col("a").alias("b"), "agreement"))
    chosen = None
    for step in range(1, steps + 1):
        left = linear if chosen is None else linear.join(chosen.select(*scope, scorer), [*scope, scorer], "left_anti")
        cost = F.lit(0.0)
        if chosen is not None:
            owed = both.join(chosen.select(*scope, F.col(scorer).alias("b")), [*scope, "b"]).groupBy(*scope, F.col("a").alias(scorer)).agg(F.sum("agreement").alias("owed"))
            left = left.join(owed, [*scope, scorer], "left")
            cost = redundancy * F.coalesce("owed", F.lit(0.0))
        gains = left.select(*scope, scorer, (F.col("gap") - cost).alias("gain"))
        best = gains.groupBy(*scope).agg(F.min(F.struct((-F.round("gain", 9)).alias("loss"), F.col(scorer).alias("who"), F.col("gain").alias("gain"))).alias("b"))
        found = best.select(*scope, F.lit(step).alias("step"), F.col("b.who").alias(scorer), F.col("b.gain").alias("gain"))
        chosen = materialize(found if chosen is None else chosen.unionAll(found), "greedy")
    return chosen


def maxmin_path(distances: DataFrame, scope: list[str], steps: int, total: bool = False) -> DataFrame:
    """(scope, step, id, distance): start from the least id, then always the id farthest from those chosen (ties: least id); with ``total`` the one with the greatest sum of distances to them (to 9 places).

    ``distances``: scope, a, b, distance, both directions. One join and aggregate per step for all scopes at once.
    """
    ids = distances.select(*scope, F.col("a").alias("id")).distinct()
    chosen = materialize(ids.groupBy(*scope).agg(F.min("id").alias("id")).select(*scope, F.lit(1).alias("step"), "id", F.lit(None).cast("double").alias("distance")), "maxmin")
    measure = F.round(F.sum("distance"), 9) if total else F.min("distance")
    for step in range(2, steps + 1):
        near = distances.join(chosen.select(*scope, F.col("id").alias("b")), [*scope, "b"]).groupBy(*scope, F.col("a").alias("id")).agg(measure.alias("distance"))
        left = near.join(chosen.select(*scope, "id"), [*scope, "id"], "left_anti")
        far = left.groupBy(*scope).agg(F.min(F.struct((-F.col("distance")).alias("d"), "id")).alias("f"))
        chosen = materialize(chosen.unionAll(far.select(*scope, F.lit(step).alias("step"), F.col("f.id").alias("id"), (-F.col("f.d")).alias("distance"))), "maxmin")
    return chosen


def one_standard_error(profile: DataFrame, scope: list[str], k: str, value: str) -> DataFrame:
    """The smallest k whose mean lies within one standard error of the best mean. ``profile``: one row per scope, fold and k."""
    each = profile.groupBy(*scope, k).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value) / F.sqrt(F.count(value)), F.lit(0.0)).alias("error"))
    best = each.groupBy(*scope).agg(F.max_by(F.struct("mean", "error"), F.struct("mean", -F.col(k))).alias("b"))
    return each.join(best, scope).where(F.col("mean") >= F.col("b.mean") - F.col("b.error")).groupBy(*scope).agg(F.min(k).alias("chosen_k"))


def marginal_stop(profile: DataFrame, scope: list[str], fold: str, k: str, value: str) -> DataFrame:
    """Per step k: mean paired gain over k-1, its standard error, and whether all steps so far keep mean - error > 0."""
    before = profile.select(*scope, fold, (F.col(k) + 1).alias(k), F.col(value).alias("__before"))
    gains = profile.join(before, [*scope, fold, k]).groupBy(*scope, k).agg(F.avg(F.col(value) - F.col("__before")).alias("mean_gain"), F.coalesce(F.stddev_samp(F.col(value) - F.col("__before")) / F.sqrt(F.count("*")), F.lit(0.0)).alias("error"))
    along = Window.partitionBy(*scope).orderBy(k).rowsBetween(Window.unboundedPreceding, 0)  # a step per scorer of the scope
    return gains.withColumn("go_on", F.bool_and(F.col("mean_gain") - F.col("error") > 0).over(along))
