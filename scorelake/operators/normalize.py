"""Normalizations fitted on one part of the rows and applied to others, and row-wise consensus scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def train_minmax(train: DataFrame, apply: DataFrame, groups: list[str], value: str, out: str = "scaled") -> DataFrame:
    """Min-max with the training bounds, not clipped; a constant group gives 0, a group without training rows null."""
    bounds = train.groupBy(*groups).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    scaled = F.when(F.col("__hi") == F.col("__lo"), 0.0).otherwise((F.col(value) - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0)))
    return apply.join(bounds, groups, "left").withColumn(out, F.when(F.col("__lo").isNotNull(), scaled)).drop("__lo", "__hi")


def scale_terms(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Adds minmax (constant: 0), maxabs (all zero: 0) and zscore (population deviation below 1e-12: 0) of a group's values."""
    stats = df.groupBy(*groups).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.max(F.abs(value)).alias("__big"), F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__sd"))
    v = F.col(value)
    return df.join(stats, groups).select(
        *df.columns,
        F.when(F.col("__hi") == F.col("__lo"), 0.0).otherwise(F.try_divide(v - F.col("__lo"), F.col("__hi") - F.col("__lo"))).alias("minmax"),
        F.when(F.col("__big") == 0, 0.0).otherwise(F.try_divide(v, F.col("__big"))).alias("maxabs"),
        F.when(F.col("__sd") < 1e-12, 0.0).otherwise(F.try_divide(v - F.col("__mean"), F.col("__sd"))).alias("zscore"),
    )


def impute_median(df: DataFrame, groups: list[str], value: str, out: str) -> DataFrame:
    """Missing values become their group's median; a group without any value stays null."""
    medians = df.groupBy(*groups).agg(F.median(value).alias("__median"))
    same = [F.col(f"r.{g}").eqNullSafe(F.col(f"m.{g}")) for g in groups]
    joined = df.alias("r").join(medians.alias("m"), same, "left")
    return joined.select(*(F.col(f"r.{c}") for c in df.columns), F.coalesce(F.col(f"r.{value}"), F.col("m.__median")).alias(out))


def signed_geometric_mean(value: Column) -> Column:
    """Geometric mean with a sign: 0 if any value is 0, null for mixed signs of an even number of values."""
    n, negative = F.count(value), F.count_if(value < 0)
    size = F.exp(F.avg(F.log(F.abs(F.nullif(value, F.lit(0.0))))))
    return F.when(F.count_if(value == 0) > 0, 0.0).when(negative == 0, size).when((negative == n) | ((n % 2 == 1) & (negative % 2 == 1)), -size).when(n % 2 == 1, size)


def consensus(df: DataFrame, rows: list[str], value: str) -> DataFrame:
    """Per row of the matrix over all its scorers: least, mean, mean of the two least, signed geometric mean."""
    two = F.sort_array(F.collect_list(value))
    agg = df.groupBy(*rows).agg(F.count(value).alias("scorers"), F.min(value).alias("least"), F.avg(value).alias("mean"), F.slice(two, 1, 2).alias("__two"), signed_geometric_mean(F.col(value)).alias("geometric"))
    return agg.select(*rows, "scorers", "least", "mean", (F.aggregate("__two", F.lit(0.0), lambda s, x: s + x) / F.size("__two")).alias("best_two_mean"), "geometric")


def soft_threshold(mean: Column, deviation: Column, support: Column, threshold: float, minimum_support: float) -> Column:
    """sign(x) * max(|x| - t * deviation, 0), kept only where enough of the parts agree in sign."""
    return F.when(support >= minimum_support, F.signum(mean) * F.greatest(F.abs(mean) - threshold * deviation, F.lit(0.0))).otherwise(0.0)
