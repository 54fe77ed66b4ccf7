"""Long score tables: latest rows, representative values, replicate statistics, audits, pivots.

Scores are entity x scorer x replicate facts, lower is better. Every aggregate here is partial
before its shuffle, so a hot scorer or entity costs one row per task and key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.numbers import settled


def latest_rows(df: DataFrame, key: list[str], version: str, order: list[str] | None = None) -> DataFrame:
    """One row per key: the one with the greatest version, then the greatest of ``order``; nulls are smallest."""
    rest = [c for c in df.columns if c not in key]
    first = [version, *(order or [])]
    last = F.max(F.struct(*first, *(c for c in rest if c not in first))).alias("__last")
    return df.groupBy(*key).agg(last).select(*key, *(F.col(f"__last.{c}").alias(c) for c in rest)).select(*df.columns)


def upsert(current: DataFrame, changes: DataFrame, key: list[str], version: str) -> DataFrame:
    """``current`` with rows of ``changes`` put in by key where they are as new or newer."""
    tagged = current.withColumn("__side", F.lit(0)).unionByName(changes.withColumn("__side", F.lit(1)))
    return latest_rows(tagged, key, version, ["__side"]).drop("__side")


def score_cells(scores: DataFrame) -> DataFrame:
    """(target_id, seed_id, ligand_id, receptor_id, score): the latest delivery of each key, failed runs and missing scores left out."""
    last = latest_rows(scores, ["target_id", "seed_id", "ligand_id", "receptor_id"], "loaded_at", ["gpu_score", "status"])
    kept = last.where((F.lower("status") != "failed") & F.col("gpu_score").isNotNull() & ~F.isnan("gpu_score"))
    return kept.select("target_id", "seed_id", "ligand_id", "receptor_id", F.col("gpu_score").alias("score"))


def binary_labels(manifest: DataFrame) -> DataFrame:
    """(ligand_id, y, split_group_id): y from the latest row with a readable label; 1 active, 0 decoy or inactive."""
    text = F.lower(F.trim("label"))
    y = F.when(text.isin("active", "1"), 1).when(text.isin("decoy", "inactive", "0"), 0)
    rows = manifest.select("ligand_id", y.alias("y"), F.upper(F.trim("split_group_id")).alias("split_group_id"), "loaded_at").where("y IS NOT NULL")
    return latest_rows(rows, ["ligand_id"], "loaded_at", ["y", "split_group_id"]).select("ligand_id", "y", "split_group_id")


def representative_scores(scores: DataFrame, first_replicate: str) -> DataFrame:
    """One row per (target, entity, scorer): the score of ``first_replicate``, else the least one; pairs without any score stay with null."""
    good = (F.lower("status") != "failed") & F.col("gpu_score").isNotNull()
    last = latest_rows(scores, ["target_id", "seed_id", "ligand_id", "receptor_id"], "loaded_at", ["gpu_score", "status"])
    first = F.min(F.when(good & (F.col("seed_id") == first_replicate), F.col("gpu_score")))
    least = F.min(F.when(good, F.col("gpu_score")))
    rows = last.groupBy("target_id", "ligand_id", "receptor_id").agg(F.coalesce(first, least).alias("representative_score"), least.alias("best_score"), F.count_if(good).alias("run_count"), F.count("*").alias("delivered_count"))
    method = F.when(F.col("run_count") == 0, "failed").when(F.col("representative_score") == F.col("best_score"), "best").otherwise("first_replicate")
    return rows.withColumn("method", method)


def replicate_summary(cells: DataFrame, near: float = 0.1) -> DataFrame:
    """Per (target, entity, scorer): exact median (to 9 places, so that equal ones tie), least, greatest, range of the replicates, which was least, and how many lie near it."""
    key = ["target_id", "ligand_id", "receptor_id"]
    agg = cells.groupBy(*key).agg(
        F.count("*").alias("replicate_count"), settled(F.median("score")).alias("median_score"), F.min("score").alias("minimum_score"), F.max("score").alias("maximum_score"),
        F.min(F.struct("score", "seed_id"))["seed_id"].alias("best_replicate"), F.sort_array(F.collect_list("score")).alias("all"),
    )
    return agg.select(*agg.columns[:-1], (F.col("maximum_score") - F.col("minimum_score")).alias("score_range"), F.size(F.filter("all", lambda x: x <= F.element_at("all", 1) + near)).alias("near_minimum_count"))


def stability(summary: DataFrame, limits: tuple[float, ...] = (0.3, 0.5, 1.0)) -> DataFrame:
    """Per scorer: mean, median, nearest-rank 95th percentile and maximum of the replicate range, and pairs above each limit."""
    over = [F.count_if(F.col("score_range") > x).alias(f"above_{str(x).replace('.', '_')}") for x in limits]
    return summary.groupBy("target_id", "receptor_id").agg(
        F.count("*").alias("pairs"), F.avg("score_range").alias("mean_range"), F.median("score_range").alias("median_range"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY score_range)").alias("p95_range"), F.max("score_range").alias("max_range"), *over
    )


def flagged_pairs(summary: DataFrame, maximum_range: float = 0.5) -> DataFrame:
    """Pairs with a non-negative score or an unstable range, with the reasons joined by ';'."""
    reasons = F.array_compact(F.array(F.when(F.col("maximum_score") >= 0, "nonnegative_score"), F.when(F.col("score_range") > maximum_range, "seed_range"), F.when(F.col("replicate_count") < 3, "missing_replicate")))
    return summary.select("target_id", "ligand_id", "receptor_id", F.array_join(reasons, ";").alias("flag_reasons"), "score_range").where("flag_reasons <> ''")


def distribution(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """count, mean, population and sample deviation (0 for one value), standard error, least, 5 %, median, 95 % (linear), greatest, positives."""
    v = F.col(value)
    n = F.count(v)
    sd = F.coalesce(F.stddev_samp(v), F.lit(0.0))
    return df.groupBy(*groups).agg(
        n.alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("pstdev"), sd.alias("stdev"), F.try_divide(sd, F.sqrt(n)).alias("standard_error"), F.min(v).alias("minimum"),
        F.percentile(v, 0.05).alias("q05"), F.median(v).alias("median"), F.percentile(v, 0.95).alias("q95"), F.max(v).alias("maximum"), F.count_if(v > 0).alias("positive_count"),
    )


def duplicate_audit(df: DataFrame, scope: list[str], key: list[str]) -> DataFrame:
    """Per scope: rows, distinct keys, keys that occur repeatedly, rows of those, greatest multiplicity."""
    each = df.groupBy(*scope, *(k for k in key if k not in scope)).agg(F.count("*").alias("m"))
    again = F.col("m") > 1
    return each.groupBy(*scope).agg(F.sum("m").alias("row_count"), F.count("*").alias("distinct_keys"), F.count_if(again).alias("duplicated_keys"), F.sum(F.when(again, F.col("m")).otherwise(0)).alias("duplicated_rows"), F.max("m").alias("max_multiplicity"))


def completeness(cells: DataFrame, entities: DataFrame, scorers: DataFrame) -> DataFrame:
    """Per (target, scorer): entities expected of the target, those of them scored, those missing, and scored ones that aren't expected. The grid itself is never built."""
    listed = entities.where("target_id IS NOT NULL AND ligand_id IS NOT NULL").select("target_id", "ligand_id").distinct()
    expected = listed.groupBy("target_id").agg(F.count("*").alias("expected"))
    have = cells.select("target_id", "receptor_id", "ligand_id").distinct().join(listed.withColumn("listed", F.lit(True)), ["target_id", "ligand_id"], "left")
    have = have.groupBy("target_id", "receptor_id").agg(F.count("listed").alias("scored"), F.count_if(F.col("listed").isNull()).alias("unknown"))
    grid = scorers.select("target_id", "receptor_id").distinct().join(expected, "target_id")
    joined = grid.join(have, ["target_id", "receptor_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select("target_id", "receptor_id", "expected", zero("scored").alias("scored"), (F.col("expected") - zero("scored")).alias("missing"), zero("unknown").alias("unknown"))


def score_matrix(cells: DataFrame, rows: list[str], column: str, values: list[str], value: str = "score") -> DataFrame:
    """Wide form: one column per value of ``column`` (given, so no extra job), missing cells null."""
    return cells.groupBy(*rows).pivot(column, values).agg(F.min(value))


def long_form(matrix: DataFrame, rows: list[str], column: str, value: str = "score") -> DataFrame:
    """Back from wide to long; missing cells are left out."""
    return matrix.unpivot(rows, [c for c in matrix.columns if c not in rows], column, value).where(F.col(value).isNotNull())


def id_sets_equal(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """One row: ids of either side, of both, and whether the sets are equal."""
    a, b = first.select(key).distinct().withColumn("a", F.lit(1)), second.select(key).distinct().withColumn("b", F.lit(1))
    both = a.join(b, key, "full_outer").agg(F.count_if(F.expr("b IS NULL")).alias("only_first"), F.count_if(F.expr("a IS NULL")).alias("only_second"), F.count_if(F.expr("a = 1 AND b = 1")).alias("in_both"))
    return both.withColumn("equal_sets", (F.col("only_first") == 0) & (F.col("only_second") == 0))


def set_digest(df: DataFrame, groups: list[str], key: str) -> DataFrame:
    """Per group: number of ids and an order-free digest of the set: the sum of the first 48 bits of each id's SHA-256. Equal sets have equal sums; it is no cryptographic digest."""
    hashed = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 12), 16, 10).cast("decimal(20,0)")
    return df.select(*groups, key).distinct().groupBy(*groups).agg(F.count("*").alias("ids"), F.sum(hashed).cast("string").alias("digest"))


def reject_reasons(df: DataFrame, rules: list[tuple[str, Column]]) -> Column:
    """The first rule that a row breaks, else 'accepted'."""
    reason = F.lit("accepted")
    for name, broken in reversed(rules):
        reason = F.when(broken, name).otherwise(reason)
    return reason
