"""Overlap, coverage and consensus of hit sets, kept as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.storage import materialize


def set_pairs(members: DataFrame, scope: list[str], owner: str, member: str, owners: DataFrame | None = None) -> DataFrame:
    """Per scope and pair of owners a < b: sizes, intersection, union, Jaccard (0 for disjoint sets, 1 for two empty ones).

    ``owners`` names owners whose sets may be empty; without it they are those with members. What
    two sets share comes from a join on the member, of which each scope has few owners (scorers).
    """
    rows = members.select(*scope, owner, member).distinct()
    sizes = rows.groupBy(*scope, owner).agg(F.count("*").alias("size"))
    if owners is not None:
        sizes = owners.select(*scope, owner).distinct().join(sizes, [*scope, owner], "left").withColumn("size", F.coalesce("size", F.lit(0)))
    sizes = materialize(sizes, "sizes")
    a, b = rows.withColumnRenamed(owner, "a"), rows.withColumnRenamed(owner, "b")
    common = a.join(b, [*scope, member]).where("a < b").groupBy(*scope, "a", "b").agg(F.count("*").alias("common"))
    one = lambda t: sizes.select(*scope, F.col(owner).alias(t), F.col("size").alias(f"size_{t}"))
    pairs = one("a").join(one("b"), scope).where("a < b").join(common, [*scope, "a", "b"], "left").withColumn("common", F.coalesce("common", F.lit(0)))
    union = F.col("size_a") + F.col("size_b") - F.col("common")
    return pairs.select(*scope, "a", "b", "size_a", "size_b", "common", union.alias("either"), F.when(union == 0, 1.0).otherwise(F.try_divide(F.col("common"), union)).alias("jaccard"))


def coverage(hits: DataFrame, labels: DataFrame, scope: list[str], owner: str) -> DataFrame:
    """Per owner: actives and decoys hit, as shares of all actives and decoys of the scope.

    ``hits``: scope, owner, entity, y; ``labels``: scope, y of every entity.
    """
    whole = labels.groupBy(*scope).agg(F.count_if(F.expr("y = 1")).alias("actives"), F.count_if(F.expr("y = 0")).alias("decoys"))
    own = hits.groupBy(*scope, owner).agg(F.count_if(F.expr("y = 1")).alias("hit_actives"), F.count_if(F.expr("y = 0")).alias("hit_decoys"))
    return own.join(whole, scope).select(*scope, owner, "hit_actives", "hit_decoys", F.try_divide("hit_actives", "actives").alias("reward"), F.try_divide("hit_decoys", "decoys").alias("exposure"))


def replicate_consensus(hits: DataFrame, scope: list[str], entity: str, replicate: str) -> DataFrame:
    """Per scope and entity: in how many replicates it is hit, and whether in most or all of those that the scope has (each has hits)."""
    n = F.countDistinct(replicate)
    there = hits.groupBy(*scope).agg(n.alias("__replicates"))
    each = hits.groupBy(*scope, entity).agg(n.alias("hits")).join(there, scope)
    return each.select(*scope, entity, "hits", (F.col("hits") * 2 > F.col("__replicates")).alias("majority"), (F.col("hits") == F.col("__replicates")).alias("every"))


def inclusion(subsets: DataFrame, scope: list[str], run: str, member: str, minimum: float) -> DataFrame:
    """Per member: the share of runs whose subset holds it, and whether it is stable."""
    runs = subsets.groupBy(*scope).agg(F.countDistinct(run).alias("runs"))
    held = subsets.groupBy(*scope, member).agg(F.countDistinct(run).alias("held"))
    return held.join(runs, scope).select(*scope, member, "held", (F.col("held") / F.col("runs")).alias("frequency"), (F.col("held") / F.col("runs") >= minimum - 1e-12).alias("stable"))
