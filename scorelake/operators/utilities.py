"""Rank utilities of scorers and of pairs of scorers, choices among subsets by them, and weighted metrics of bootstrap draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.operators.prefix import running_totals
from scorelake.operators.ranking import pearson
from scorelake.operators.resampling import poisson_weight, uniform


def rank_shares(cells: DataFrame, groups: list[str], score: str, entity: str) -> DataFrame:
    """Adds r, the position by (score, id) as a share of the group's rows."""
    placed = running_totals(cells.where(F.col(score).isNotNull()), groups, [score, entity], {"__before": None}, totals=True)
    return placed.select(*cells.columns, ((F.col("__before") + 1) / F.col("__before_all")).alias("r"))


def _contrast(r: Column, y: Column, alpha: float) -> Column:
    """Mean of exp(-alpha * r) of the actives less that of the decoys."""
    gain = F.exp(-alpha * r)
    return F.avg(F.when(y == 1, gain)) - F.avg(F.when(y == 0, gain))


def rank_utility(ranks: DataFrame, scope: list[str], scorer: str, replicate: str, alpha: float = 20.0) -> DataFrame:
    """(scope, scorer, replicates, utility): mean of the average and the least replicate of the early-rank contrast of the classes."""
    each = ranks.groupBy(*scope, scorer, replicate).agg(_contrast(F.col("r"), F.col("y"), alpha).alias("u")).where("u IS NOT NULL")
    return each.groupBy(*scope, scorer).agg(F.count("*").alias("replicates"), ((F.avg("u") + F.min("u")) / 2).alias("utility"))


def pair_rank_terms(ranks: DataFrame, scope: list[str], scorer: str, replicate: str, entity: str, alpha: float = 20.0) -> DataFrame:
    """(scope, a, b, common, utility, redundancy): utility of the better rank of two scorers, and the least correlation of their ranks over the replicates, not below 0.

    Pairs meet in the entities that both scored in a replicate; of these each has as many as it has scorers.
    """
    side = lambda t: ranks.select(*scope, replicate, entity, "y", F.col(scorer).alias(t), F.col("r").alias(f"r_{t}"))
    both = side("a").join(side("b").drop("y"), [*scope, replicate, entity]).where("a < b")
    each = both.groupBy(*scope, "a", "b", replicate).agg(F.count("*").alias("n"), _contrast(F.least("r_a", "r_b"), F.col("y"), alpha).alias("u"), pearson(F.col("r_a"), F.col("r_b")).alias("c"))
    return each.groupBy(*scope, "a", "b").agg(F.sum("n").alias("common"), ((F.avg("u") + F.min("u")) / 2).alias("utility"), F.greatest(F.lit(0.0), F.coalesce(F.min("c"), F.lit(0.0))).alias("redundancy"))


def supported_intervals(values: DataFrame, scope: list[str], k: str, value: str) -> DataFrame:
    """(scope, k, from_cost, to_cost): the costs per unit of k at which k is the best of value - cost * k; nulls are open ends.

    ``values``: one row per scope and k; sizes of a scope are compared with each other.
    """
    other = values.select(*scope, F.col(k).alias("__k"), F.col(value).alias("__v"))
    slope = (F.col(value) - F.col("__v")) / (F.col(k) - F.col("__k"))
    both = values.join(other, scope).where(F.col(k) != F.col("__k"))
    ends = both.groupBy(*scope, k).agg(F.max(F.when(F.col("__k") > F.col(k), slope)).alias("from_cost"), F.min(F.when(F.col("__k") < F.col(k), slope)).alias("to_cost"))
    return values.select(*scope, k).join(ends, [*scope, k], "left").withColumn("supported", F.coalesce(F.col("from_cost") <= F.col("to_cost"), F.lit(True)))


def bootstrap_metrics(rows: DataFrame, scope: list[str], unit: str, entity: str, score: str, y: str, replicates: int, seed: str, alpha: float = 20.0) -> DataFrame:
    """(scope, replicate, roc_auc, average_precision, bedroc) of bootstrap draws of whole units (entities, or groups of them as blocks).

    A draw takes a row as often as the Poisson count of its unit, so every row keeps its place in
    the order and counts w times there. Sums in front of a row are running totals by replicate; AUC
    counts ties as half, the others break them by id. Draws without one of the classes give nulls.
    """
    drawn = rows.where(F.col(score).isNotNull() & F.col(y).isNotNull()).select(*scope, unit, *([entity] if entity != unit else []), score, y)
    drawn = drawn.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("w", poisson_weight(uniform(seed, "replicate", unit))).where("w > 0")
    drawn = drawn.withColumn("wa", F.col("w") * F.col(y))
    full = running_totals(drawn, [*scope, "replicate"], [score, entity], {"n0": "w", "a0": "wa"}, totals=True)
    n, p = F.col("n0_all"), F.col("a0_all")
    copies = F.sequence(F.lit(1), F.col("w"))
    ap = F.when(F.col(y) == 1, F.aggregate(copies, F.lit(0.0), lambda s, j: s + (F.col("a0") + j) / (F.col("n0") + j)))
    early = F.when(F.col(y) == 1, F.aggregate(copies, F.lit(0.0), lambda s, j: s + F.exp(-alpha * (F.col("n0") + j) / n)))
    full = full.select(*scope, "replicate", score, "w", "wa", "n0", "a0", "n0_all", "a0_all", ap.alias("ap"), early.alias("e"))
    sums, firsts = ("w", "wa", "ap", "e"), ("n0", "a0", "n0_all", "a0_all")
    ties = full.groupBy(*scope, "replicate", score).agg(*(F.sum(F.col(c)).alias(f"t_{c}") for c in sums), *(F.min(F.col(c)).alias(f"t_{c}") for c in firsts)).withColumnsRenamed({f"t_{c}": c for c in (*sums, *firsts)})
    decoys = F.col("w") - F.col("wa")
    behind = (n - p) - (F.col("n0") - F.col("a0")) - decoys + decoys / 2
    one = ties.groupBy(*scope, "replicate").agg(F.first("n0_all").alias("n0_all"), F.first("a0_all").alias("a0_all"), F.sum(F.col("wa") * behind).alias("won"), F.sum("ap").alias("ap"), F.sum("e").alias("e"))
    q = F.exp(-alpha / n)
    best = F.try_divide(q * (1 - F.pow(q, p)), 1 - q)
    worst = best * F.pow(q, n - p)
    both = (p > 0) & (p < n)
    return one.select(*scope, "replicate", F.when(both, F.try_divide(F.col("won"), p * (n - p))).alias("roc_auc"), F.try_divide("ap", p).alias("average_precision"), F.when(both, F.try_divide(F.col("e") - worst, best - worst)).alias("bedroc"))


def intervals(draws: DataFrame, scope: list[str], values: list[str]) -> DataFrame:
    """Per scope: valid draws, and of each value its mean and 95 % interval."""
    of = lambda v: [F.avg(v).alias(f"{v}_mean"), F.percentile(v, 0.025).alias(f"{v}_low"), F.percentile(v, 0.975).alias(f"{v}_high")]
    return draws.groupBy(*scope).agg(F.count(values[0]).alias("valid"), *(c for v in values for c in of(v)))


def drawn_subsets(members: DataFrame, scope: list[str], member: str, size: int, draws: int, seed: str) -> DataFrame:
    """(scope, draw, member): ``draws`` random subsets of each scope, those members that come first in the draw's hash order; one row per member and draw is ranked."""
    rows = members.select(*scope, member).distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("__u", uniform(seed, "draw", member))
    first = F.row_number().over(Window.partitionBy(*scope, "draw").orderBy("__u", member))  # the scorers of a scope
    return rows.withColumn("__r", first).where(F.col("__r") <= size).select(*scope, "draw", member)
