"""Deterministic folds, splits, samples and linked groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.operators.prefix import row_numbers, running_total, running_totals
from scorelake.storage import materialize, release


def draw(seed: str, key: str) -> Column:
    """A random-looking order that every engine computes alike: the SHA-256 of seed|key."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256)


def hash_folds(df: DataFrame, strata: list[str], key: str, folds: int, seed: str) -> DataFrame:
    """Adds fold: the rank in hash order within the stratum, modulo the number of folds."""
    placed = row_numbers(df.withColumn("__draw", draw(seed, key)), strata, ["__draw", key], "__rank")
    return placed.withColumn("fold", ((F.col("__rank") - 1) % folds).cast("int")).drop("__draw", "__rank")


def stratified_split(df: DataFrame, strata: list[str], key: str, train: float, validation: float, seed: str) -> DataFrame:
    """Adds split: the first round(n*train) of a stratum in hash order, then round(n*validation), then test."""
    placed = running_totals(df.withColumn("__draw", draw(seed, key)), strata, ["__draw", key], {"__before": None}, totals=True)
    n = F.col("__before_all")
    a, b = F.floor(n * train + 0.5), F.floor(n * validation + 0.5)
    split = F.when(F.col("__before") < a, "train").when(F.col("__before") < a + b, "validation").otherwise("test")
    return placed.select(*df.columns, split.alias("split"))


def sample_per_stratum(df: DataFrame, strata: list[str], group: str, key: str, count: int, seed: str) -> DataFrame:
    """At most ``count`` rows of each stratum in hash order, no two of one group."""
    drawn = df.withColumn("__draw", draw(seed, key))
    first = drawn.groupBy(*strata, group).agg(F.min(F.struct("__draw", key)).alias("__first"))
    placed = row_numbers(first.select(*strata, group, F.col(f"__first.{key}").alias(key), F.col("__first.__draw").alias("__draw")), strata, ["__draw", key], "rank")
    return placed.where(F.col("rank") <= count).drop("__draw")


def fill_by_groups(df: DataFrame, scope: list[str], group: str, budget: int, seed: str) -> DataFrame:
    """Whole groups in hash order until the budget of rows is reached; the last one may overshoot."""
    sizes = df.groupBy(*scope, group).agg(F.count("*").alias("size")).withColumn("__draw", draw(seed, group))
    return running_total(sizes, scope, ["__draw", group], "size", "rows_before").where(F.col("rows_before") < budget).drop("__draw")


def exact_fill(df: DataFrame, scope: list[str], group: str, room: int, seed: str) -> DataFrame:
    """(scope, group, size, room_left): whole groups in hash order, each taken if it still fits into ``room`` rows, else passed over.

    Going through the groups one by one isn't needed: of those that could still fit, the longest
    beginning of the order whose sizes fit is taken at once, then what no longer fits is dropped. The
    group that ended a beginning is among the dropped ones, so every round ends with less room or no
    group. Null groups are left out; an empty table gives no row.
    """
    sizes = df.where(F.col(group).isNotNull()).groupBy(*scope, group).agg(F.count("*").alias("size")).withColumn("__draw", draw(seed, group))
    left = materialize(sizes.withColumn("__room", F.lit(room).cast("long")).where(F.col("size") <= F.col("__room")), "left")
    taken = None
    while not left.isEmpty():
        along = running_totals(left, scope, ["__draw", group], {"__before": "size"})
        placed = materialize(along.withColumn("__after", F.col("__before") + F.col("size")), "placed")
        now = placed.where("__after <= __room").select(*scope, group, "size", (F.col("__room") - F.col("__after")).alias("room_left"))
        taken = now if taken is None else taken.unionAll(now)
        rest = now.groupBy(*scope).agg(F.min("room_left").alias("__rest"))
        later = placed.where("__after > __room").join(rest, scope)
        left = materialize(later.where("size <= __rest").select(*scope, group, "size", "__draw", F.col("__rest").alias("__room")), "left")
    return sizes.select(*scope, group, "size", F.lit(0).cast("long").alias("room_left")).limit(0) if taken is None else taken


def balanced_group_folds(df: DataFrame, scope: list[str], group: str, folds: int) -> DataFrame:
    """(scope, group, size, fold): whole groups, largest first, dealt to and fro over the folds."""
    sizes = df.groupBy(*scope, group).agg(F.count("*").alias("size")).withColumn("__small", -F.col("size"))
    placed = row_numbers(sizes, scope, ["__small", group], "__rank")
    turn, at = F.floor((F.col("__rank") - 1) / folds), (F.col("__rank") - 1) % folds
    return placed.withColumn("fold", F.when(turn % 2 == 0, at).otherwise(folds - 1 - at).cast("int")).drop("__small", "__rank")


def crossing_groups(df: DataFrame, group: str, fold: str) -> DataFrame:
    """Groups whose rows lie in more than one fold; none if the folds isolate groups."""
    return df.where(F.col(group).isNotNull() & F.col(fold).isNotNull()).groupBy(group).agg(F.countDistinct(fold).alias("folds"), F.count("*").alias("members")).where(F.col("folds") > 1)


def linked_groups(df: DataFrame, key: str, links: list[str], rounds: int = 60) -> DataFrame:
    """(key, group_key): the smallest key among all rows linked through equal values of any link column, by propagation of least labels.

    Nulls link nothing. Each round takes the least label of every shared value, then of every key,
    and jumps to that label's own; it ends when nothing changes.
    """
    pairs = df.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("text")) for c in links))).alias("link")).where("link.text IS NOT NULL").distinct()
    pairs = materialize(pairs, "links")
    labels = materialize(df.select(key, F.col(key).alias("label")).where(F.col(key).isNotNull()).distinct(), "labels")
    before = labels
    for _ in range(rounds):
        by_link = pairs.join(labels, key).groupBy("link").agg(F.min("label").alias("label"))
        offered = pairs.join(by_link, "link").groupBy(key).agg(F.min("label").alias("offer"))
        moved = labels.join(offered, key, "left").select(key, "label", F.least("label", F.coalesce("offer", "label")).alias("next"))
        jump = moved.select(F.col(key).alias("next"), F.col("next").alias("further"))
        following = materialize(moved.join(jump, "next", "left").select(key, F.col("label").alias("old"), F.coalesce("further", "next").alias("label")), "labels")
        labels, done = following.select(key, "label"), before
        before = following
        release(done)
        if following.where("old <> label").isEmpty():
            return labels.withColumnRenamed("label", "group_key")
    raise RuntimeError("labels still move")
