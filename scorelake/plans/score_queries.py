"""Queries over score tables: audits, representatives, replicate statistics, metrics, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions.numbers import settled
from scorelake.operators import ranking, scores, series
from scorelake.plans.base import _metrics_sql, cells, labelled, labelled_cells, query, summary
from scorelake.sources.tables import table

PAIR = ["target_id", "receptor_id"]


@query("SELECT target_id, seed_id, ligand_id, receptor_id, score FROM cells", "cells")
def score_cells(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d)


@query("SELECT target_id, CAST(sum(m) AS BIGINT) AS row_count, count(*) AS distinct_keys, count(*) FILTER (m > 1) AS duplicated_keys, CAST(coalesce(sum(m) FILTER (m > 1), 0) AS BIGINT) AS duplicated_rows, max(m) AS max_multiplicity FROM (SELECT target_id, seed_id, ligand_id, receptor_id, count(*) AS m FROM seed_scores GROUP BY ALL) GROUP BY ALL")
def duplicate_audit(spark: SparkSession, d: str) -> DataFrame:
    return scores.duplicate_audit(table(spark, d, "seed_scores"), ["target_id"], ["target_id", "seed_id", "ligand_id", "receptor_id"])


_GOOD = "lower(status) <> 'failed' AND gpu_score IS NOT NULL"


@query(
    f"""SELECT *, CASE WHEN run_count = 0 THEN 'failed' WHEN representative_score = best_score THEN 'best' ELSE 'first_replicate' END AS method FROM (SELECT target_id, ligand_id, receptor_id,
 coalesce(min(gpu_score) FILTER ({_GOOD} AND seed_id = 's11'), min(gpu_score) FILTER ({_GOOD})) AS representative_score, min(gpu_score) FILTER ({_GOOD}) AS best_score, count(*) FILTER ({_GOOD}) AS run_count, count(*) AS delivered_count FROM latest GROUP BY ALL)""",
    "latest",
)
def representative_scores(spark: SparkSession, d: str) -> DataFrame:
    return scores.representative_scores(table(spark, d, "seed_scores"), "s11")


@query("SELECT s.target_id, s.ligand_id, s.receptor_id, any_value(replicate_count) AS replicate_count, round(any_value(median_score), 9) AS median_score, any_value(minimum_score) AS minimum_score, any_value(maximum_score) AS maximum_score, any_value(best_replicate) AS best_replicate, CAST(count(*) FILTER (score <= minimum_score + CAST(0.1 AS DOUBLE)) AS INTEGER) AS near_minimum_count, round(any_value(score_range), 9) AS score_range FROM summary s JOIN cells c USING (target_id, ligand_id, receptor_id) GROUP BY ALL", "summary")
def replicate_summary(spark: SparkSession, d: str) -> DataFrame:
    return summary(spark, d)


@query("SELECT target_id, receptor_id, count(*) AS pairs, round(avg(score_range), 9) AS mean_range, round(median(score_range), 9) AS median_range, round(quantile_disc(score_range, 0.95), 9) AS p95_range, round(max(score_range), 9) AS max_range, count(*) FILTER (score_range > CAST(0.3 AS DOUBLE)) AS above_0_3, count(*) FILTER (score_range > CAST(0.5 AS DOUBLE)) AS above_0_5, count(*) FILTER (score_range > CAST(1.0 AS DOUBLE)) AS above_1_0 FROM summary GROUP BY ALL", "summary")
def replicate_stability(spark: SparkSession, d: str) -> DataFrame:
    return scores.stability(summary(spark, d))


@query("SELECT * FROM (SELECT target_id, ligand_id, receptor_id, concat_ws(';', CASE WHEN maximum_score >= 0 THEN 'nonnegative_score' END, CASE WHEN score_range > CAST(0.5 AS DOUBLE) THEN 'seed_range' END, CASE WHEN replicate_count < 3 THEN 'missing_replicate' END) AS flag_reasons, round(score_range, 9) AS score_range FROM summary) WHERE flag_reasons <> ''", "summary")
def flagged_pairs(spark: SparkSession, d: str) -> DataFrame:
    return scores.flagged_pairs(summary(spark, d))


@query(
    """SELECT target_id, receptor_id, count(score) AS n, round(avg(score), 9) AS mean, round(stddev_pop(score), 9) AS pstdev, round(coalesce(stddev_samp(score), 0), 9) AS stdev, round(coalesce(stddev_samp(score), 0) / sqrt(count(score)), 9) AS standard_error, min(score) AS minimum,
 round(quantile_cont(score, 0.05), 9) AS q05, round(median(score), 9) AS median, round(quantile_cont(score, 0.95), 9) AS q95, max(score) AS maximum, count(*) FILTER (score > 0) AS positive_count FROM cells GROUP BY ALL""",
    "cells",
)
def score_distribution(spark: SparkSession, d: str) -> DataFrame:
    return scores.distribution(cells(spark, d), PAIR, "score")


@query("WITH l AS (SELECT DISTINCT target_id, ligand_id FROM ligands WHERE target_id IS NOT NULL AND ligand_id IS NOT NULL), e AS (SELECT target_id, count(*) AS expected FROM l GROUP BY ALL), h AS (SELECT c.target_id, receptor_id, count(DISTINCT l.ligand_id) AS scored, count(DISTINCT c.ligand_id) FILTER (l.ligand_id IS NULL) AS unknown FROM cells c LEFT JOIN l USING (target_id, ligand_id) GROUP BY ALL), s AS (SELECT DISTINCT target_id, receptor_id FROM seed_scores) SELECT target_id, receptor_id, expected, coalesce(scored, 0) AS scored, expected - coalesce(scored, 0) AS missing, coalesce(unknown, 0) AS unknown FROM s JOIN e USING (target_id) LEFT JOIN h USING (target_id, receptor_id)", "cells")
def grid_completeness(spark: SparkSession, d: str) -> DataFrame:
    return scores.completeness(cells(spark, d), table(spark, d, "ligands"), table(spark, d, "seed_scores"))


_SEEDS = ["s11", "s23", "s37", "s41", "s53", "s67"]  # SQL names its columns; the queries take them from the table
#: Columns that a matrix may have; beyond, its long form is the table to use.
MOST_SEEDS = 1000


def _seeds(spark: SparkSession, d: str) -> list[str]:
    """The replicates of the table's cells, sorted."""
    found = sorted(r[0] for r in cells(spark, d).where("seed_id IS NOT NULL").select("seed_id").distinct().limit(MOST_SEEDS + 1).collect())
    if len(found) > MOST_SEEDS:
        raise ValueError(f"more than {MOST_SEEDS} replicates for the columns of a matrix")
    return found


@query("SELECT target_id, ligand_id, receptor_id, " + ", ".join(f"min(score) FILTER (seed_id = '{s}') AS {s}" for s in _SEEDS) + " FROM cells GROUP BY ALL", "cells")
def score_matrix(spark: SparkSession, d: str) -> DataFrame:
    """One column per replicate of the table."""
    return scores.score_matrix(cells(spark, d), ["target_id", "ligand_id", "receptor_id"], "seed_id", _seeds(spark, d))


@query("SELECT target_id, ligand_id, receptor_id, seed_id, score FROM cells WHERE seed_id IS NOT NULL", "cells")
def matrix_to_long(spark: SparkSession, d: str) -> DataFrame:
    wide = scores.score_matrix(cells(spark, d), ["target_id", "ligand_id", "receptor_id"], "seed_id", _seeds(spark, d))
    return scores.long_form(wide, ["target_id", "ligand_id", "receptor_id"], "seed_id")


@query("SELECT *, only_first = 0 AND only_second = 0 AS equal_sets FROM (SELECT count(*) FILTER (b IS NULL) AS only_first, count(*) FILTER (a IS NULL) AS only_second, count(*) FILTER (a = 1 AND b = 1) AS in_both FROM (SELECT DISTINCT ligand_id, 1 AS a FROM seed_scores) FULL JOIN (SELECT DISTINCT ligand_id, 1 AS b FROM ligands) USING (ligand_id))")
def id_sets_equal(spark: SparkSession, d: str) -> DataFrame:
    return scores.id_sets_equal(table(spark, d, "seed_scores"), table(spark, d, "ligands"), "ligand_id")


@query("SELECT target_id, count(*) AS ids, CAST(sum(CAST('0x' || substr(sha256(ligand_id), 1, 12) AS BIGINT)) AS VARCHAR) AS digest FROM (SELECT DISTINCT target_id, ligand_id FROM seed_scores) GROUP BY ALL")
def identifier_digest(spark: SparkSession, d: str) -> DataFrame:
    return scores.set_digest(table(spark, d, "seed_scores"), ["target_id"], "ligand_id")


@query("SELECT target_id, CASE WHEN gpu_score IS NULL THEN 'no_score' WHEN lower(status) = 'failed' THEN 'failed' WHEN abs(gpu_score) > 20 THEN 'implausible' WHEN gpu_score >= 0 THEN 'nonnegative' ELSE 'accepted' END AS reason, count(*) AS row_count FROM seed_scores GROUP BY ALL")
def reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    rules = [("no_score", F.col("gpu_score").isNull()), ("failed", F.lower("status") == "failed"), ("implausible", F.abs("gpu_score") > 20), ("nonnegative", F.col("gpu_score") >= 0)]
    return table(spark, d, "seed_scores").groupBy("target_id", scores.reject_reasons(None, rules).alias("reason")).agg(F.count("*").alias("row_count"))


@query("SELECT coalesce(selection_role, 'none') AS selection_role, coalesce(lower(trim(label)), 'none') AS label, count(*) AS ligand_count, count(DISTINCT ligand_id) AS distinct_ligands FROM ligands GROUP BY ALL")
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ligands")
    return rows.groupBy(F.coalesce("selection_role", F.lit("none")).alias("selection_role"), F.coalesce(F.lower(F.trim("label")), F.lit("none")).alias("label")).agg(F.count("*").alias("ligand_count"), F.countDistinct("ligand_id").alias("distinct_ligands"))


@query("SELECT CASE WHEN grouping(target_id) = 1 THEN 'ALL' ELSE target_id END AS scope, seed_id, count(*) AS row_count, count(DISTINCT ligand_id) AS entities, round(avg(score), 9) AS mean_value FROM cells GROUP BY GROUPING SETS ((seed_id), (seed_id, target_id))", "cells")
def scope_summary(spark: SparkSession, d: str) -> DataFrame:
    return series.scope_summary(cells(spark, d), "target_id", ["seed_id"], "score", "ligand_id")


@query("SELECT source, seed_id, count(*) AS row_count, count(DISTINCT target_id || '|' || receptor_id) AS scorers FROM (SELECT 'primary' AS source, target_id, seed_id, receptor_id FROM seed_scores UNION ALL SELECT 'mirror', target_id, seed_id, receptor_id FROM seed_scores_mirror) GROUP BY ALL")
def union_sources(spark: SparkSession, d: str) -> DataFrame:
    a, b = (table(spark, d, n).select(F.lit(s).alias("source"), "target_id", "seed_id", "receptor_id") for s, n in (("primary", "seed_scores"), ("mirror", "seed_scores_mirror")))
    return a.unionByName(b).groupBy("source", "seed_id").agg(F.count("*").alias("row_count"), F.countDistinct(F.concat_ws("|", "target_id", "receptor_id")).alias("scorers"))


@query("WITH k AS (SELECT DISTINCT ligand_id FROM ligands WHERE outer_fold IS NOT NULL AND outer_fold <> 0) SELECT target_id, count(*) FILTER (s.ligand_id IN (SELECT ligand_id FROM k)) AS kept_rows, count(*) FILTER (s.ligand_id NOT IN (SELECT ligand_id FROM k)) AS skipped_rows FROM seed_scores s GROUP BY ALL")
def development_subset(spark: SparkSession, d: str) -> DataFrame:
    kept = table(spark, d, "ligands").where("outer_fold IS NOT NULL AND outer_fold <> 0").select("ligand_id").distinct().withColumn("kept", F.lit(True))
    return table(spark, d, "seed_scores").select("target_id", "ligand_id").join(kept, "ligand_id", "left").groupBy("target_id").agg(F.count_if("kept").alias("kept_rows"), F.count_if(F.expr("kept IS NULL")).alias("skipped_rows"))


@query("SELECT target_id, seed_id, ligand_id, receptor_id FROM latest l ANTI JOIN (SELECT DISTINCT target_id, seed_id, upper(trim(ligand_id)) AS ligand_id, receptor_id FROM seed_scores_mirror) m USING (target_id, seed_id, ligand_id, receptor_id)", "latest")
def pending_runs(spark: SparkSession, d: str) -> DataFrame:
    key = ["target_id", "seed_id", "ligand_id", "receptor_id"]
    done = table(spark, d, "seed_scores_mirror").select("target_id", "seed_id", F.upper(F.trim("ligand_id")).alias("ligand_id"), "receptor_id")
    return table(spark, d, "seed_scores").select(*key).distinct().join(done, key, "left_anti")


@query("SELECT * FROM metrics", "metrics")
def screening_metrics(spark: SparkSession, d: str) -> DataFrame:
    return ranking.screening_metrics(labelled(spark, d), PAIR, "median_score", "ligand_id", "y")


@query("SELECT * FROM seedmetrics", "seedmetrics")
def screening_metrics_by_replicate(spark: SparkSession, d: str) -> DataFrame:
    return ranking.screening_metrics(labelled_cells(spark, d), [*PAIR, "seed_id"], "score", "ligand_id", "y")


@query("SELECT target_id, receptor_id, m.bedroc AS primary_bedroc, round(avg(s.bedroc), 9) AS mean_replicate, min(s.bedroc) AS worst_replicate, count(s.bedroc) AS replicates, round((m.bedroc + avg(s.bedroc) + min(s.bedroc)) / 3, 5) AS composite FROM metrics m JOIN seedmetrics s USING (target_id, receptor_id) GROUP BY target_id, receptor_id, m.bedroc", "metrics seedmetrics")
def robust_metrics(spark: SparkSession, d: str) -> DataFrame:
    primary = screening_metrics(spark, d).select(*PAIR, settled("bedroc").alias("primary_bedroc"))
    by_seed = screening_metrics_by_replicate(spark, d).select(*PAIR, settled("bedroc").alias("b")).groupBy(*PAIR).agg(F.avg("b").alias("mean_replicate"), F.min("b").alias("worst_replicate"), F.count("b").alias("replicates"))
    return primary.join(by_seed, PAIR).withColumn("composite", F.round((F.col("primary_bedroc") + F.col("mean_replicate") + F.col("worst_replicate")) / 3, 5))


_SPLIT = "CASE WHEN CAST('0x' || substr(sha256('split|' || ligand_id), 1, 12) AS BIGINT) % 5 = 0 THEN 'test' WHEN CAST('0x' || substr(sha256('split|' || ligand_id), 1, 12) AS BIGINT) % 5 = 1 THEN 'validation' ELSE 'train' END"


def split_of(c: str):
    """train, validation or test of an id, by hash alone."""
    part = F.conv(F.substring(F.sha2(F.concat(F.lit("split|"), F.col(c)), 256), 1, 12), 16, 10).cast("long") % 5
    return F.when(part == 0, "test").when(part == 1, "validation").otherwise("train")


def _metrics_of(select: str, groups: str, score: str) -> str:
    return f"WITH source AS ({select}) {_metrics_sql('source', groups, score)}"


@query(_metrics_of("SELECT target_id, ligand_id, y, 'least' AS method, min(median_score) AS value FROM lab GROUP BY ALL UNION ALL SELECT target_id, ligand_id, y, 'mean', round(avg(median_score), 9) FROM lab GROUP BY ALL", "target_id, method", "value"), "lab")
def consensus_metrics(spark: SparkSession, d: str) -> DataFrame:
    both = labelled(spark, d).groupBy("target_id", "ligand_id", "y").agg(F.min("median_score").alias("least"), settled(F.avg("median_score")).alias("mean"))
    return ranking.screening_metrics(both.unpivot(["target_id", "ligand_id", "y"], ["least", "mean"], "method", "value"), ["target_id", "method"], "value", "ligand_id", "y")


@query(_metrics_of(f"SELECT target_id, ligand_id, y, {_SPLIT} AS split, min(median_score) AS value FROM lab GROUP BY ALL", "target_id, split", "value"), "lab")
def split_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d).groupBy("target_id", "ligand_id", "y").agg(F.min("median_score").alias("value")).withColumn("split", split_of("ligand_id"))
    return ranking.screening_metrics(rows, ["target_id", "split"], "value", "ligand_id", "y")


@query("SELECT target_id, count(*) AS scorers, round(avg(roc_auc), 5) AS mean_auc, round(avg(average_precision), 5) AS mean_ap, round(avg(bedroc), 5) AS mean_bedroc FROM metrics GROUP BY ALL", "metrics")
def mean_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = screening_metrics(spark, d)
    return rows.groupBy("target_id").agg(F.count("*").alias("scorers"), *(F.round(F.avg(settled(c)), 5).alias(n) for c, n in (("roc_auc", "mean_auc"), ("average_precision", "mean_ap"), ("bedroc", "mean_bedroc"))))


@query("SELECT target_id, receptor_id, ligand_id, median_score, y, position FROM top", "top")
def top_rows(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_rows(labelled(spark, d).select(*PAIR, "ligand_id", "median_score", "y"), PAIR, "median_score", "ligand_id", 0.1)


@query("SELECT target_id, receptor_id, roc_auc, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY roc_auc DESC NULLS LAST, average_precision DESC NULLS LAST, receptor_id) AS rank FROM metrics) WHERE rank <= 3", "metrics")
def best_receptors(spark: SparkSession, d: str) -> DataFrame:
    rows = screening_metrics(spark, d).select(*PAIR, settled("roc_auc").alias("roc_auc"), settled("average_precision").alias("ap"))
    order = [F.desc_nulls_last("roc_auc"), F.desc_nulls_last("ap"), F.asc("receptor_id")]
    return ranking.best_groups(rows, ["target_id"], order, 3).select(*PAIR, "roc_auc", "rank")


@query(
    """SELECT target_id, receptor_id, ligand_id, median_score, row_number() OVER w AS position, rank() OVER v AS competition_rank, round(rank() OVER v + (count(*) OVER (PARTITION BY target_id, receptor_id, median_score) - 1) / 2.0, 9) AS average_rank,
 round(cume_dist() OVER v, 9) AS share_at_most, round(coalesce((row_number() OVER w - 1) / nullif(count(*) OVER (PARTITION BY target_id, receptor_id) - 1.0, 0), 0), 9) AS rank_fraction FROM summary WINDOW w AS (PARTITION BY target_id, receptor_id ORDER BY median_score, ligand_id), v AS (PARTITION BY target_id, receptor_id ORDER BY median_score)""",
    "summary",
)
def ranked_scores(spark: SparkSession, d: str) -> DataFrame:
    return ranking.ranked(summary(spark, d).select(*PAIR, "ligand_id", "median_score"), PAIR, "median_score", "ligand_id")


@query(
    f"""WITH s AS (SELECT *, {_SPLIT} AS split FROM summary), t AS (SELECT target_id, receptor_id, median_score AS v, count(*) AS c FROM s WHERE split = 'train' GROUP BY ALL), n AS (SELECT target_id, receptor_id, sum(c) AS n FROM t GROUP BY ALL)
 SELECT s.target_id, s.receptor_id, s.ligand_id, s.median_score, s.split, round((coalesce(sum(t.c) FILTER (t.v < s.median_score), 0) + coalesce(sum(t.c) FILTER (t.v = s.median_score), 0) / 2.0 + 0.5) / (any_value(n.n) + 1), 9) AS mid_rank, round(coalesce(sum(t.c) FILTER (t.v <= s.median_score), 0) / any_value(n.n), 9) AS share_at_most
 FROM s LEFT JOIN n USING (target_id, receptor_id) LEFT JOIN t USING (target_id, receptor_id) GROUP BY s.target_id, s.receptor_id, s.ligand_id, s.median_score, s.split""",
    "summary",
)
def rank_transform(spark: SparkSession, d: str) -> DataFrame:
    rows = summary(spark, d).select(*PAIR, "ligand_id", "median_score").withColumn("split", split_of("ligand_id"))
    return ranking.train_rank_transform(rows.where("split = 'train'"), rows, PAIR, "median_score")


@query(
    """WITH a AS (SELECT target_id, receptor_id, ligand_id, score AS x FROM cells WHERE seed_id = 's11'), b AS (SELECT target_id, receptor_id, ligand_id, score AS z FROM cells WHERE seed_id = 's23'), j AS (SELECT *, avg(rx) OVER (PARTITION BY target_id, receptor_id, x) AS ax, avg(rz) OVER (PARTITION BY target_id, receptor_id, z) AS az FROM (SELECT target_id, receptor_id, x, z, row_number() OVER (PARTITION BY target_id, receptor_id ORDER BY x) AS rx, row_number() OVER (PARTITION BY target_id, receptor_id ORDER BY z) AS rz FROM a JOIN b USING (target_id, receptor_id, ligand_id)))
 SELECT target_id, receptor_id, count(*) AS n, round(CASE WHEN var_pop(x) * count(*) > 1e-18 AND var_pop(z) * count(*) > 1e-18 THEN covar_pop(x, z) / sqrt(var_pop(x) * var_pop(z)) END, 5) AS pearson, round(CASE WHEN var_pop(ax) * count(*) > 1e-18 AND var_pop(az) * count(*) > 1e-18 THEN covar_pop(ax, az) / sqrt(var_pop(ax) * var_pop(az)) END, 5) AS spearman FROM j GROUP BY ALL""",
    "cells",
)
def replicate_correlation(spark: SparkSession, d: str) -> DataFrame:
    rows = cells(spark, d)
    both = rows.where("seed_id = 's11'").select(*PAIR, "ligand_id", F.col("score").alias("x")).join(rows.where("seed_id = 's23'").select(*PAIR, "ligand_id", F.col("score").alias("z")), [*PAIR, "ligand_id"])
    for v in ("x", "z"):
        ranks = ranking.value_ranks(both, PAIR, v).select(*PAIR, v, (F.col("less") + (F.col("equal") + 1) / 2).alias(f"a{v}"))
        both = both.join(ranks, [*PAIR, v])
    return both.groupBy(*PAIR).agg(F.count("*").alias("n"), F.round(ranking.pearson(F.col("x"), F.col("z")), 5).alias("pearson"), F.round(ranking.pearson(F.col("ax"), F.col("az")), 5).alias("spearman"))


_TOPSEED = "SELECT target_id, receptor_id, seed_id, ligand_id FROM (SELECT *, row_number() OVER (PARTITION BY target_id, receptor_id, seed_id ORDER BY score, ligand_id) AS r, count(*) OVER (PARTITION BY target_id, receptor_id, seed_id) AS n FROM cells) WHERE r <= greatest(1, ceil(n * CAST(0.1 AS DOUBLE)))"


@query(f"WITH t AS ({_TOPSEED}) SELECT target_id, receptor_id, (SELECT NULL) IS NULL AS compared, count(*) FILTER (b.ligand_id IS NOT NULL) AS common, count(*) AS top_count, round(count(*) FILTER (b.ligand_id IS NOT NULL) * 1.0 / count(*), 9) AS overlap FROM (SELECT * FROM t WHERE seed_id = 's11') a LEFT JOIN (SELECT * FROM t WHERE seed_id = 's23') b USING (target_id, receptor_id, ligand_id) GROUP BY target_id, receptor_id", "cells")
def top_overlap(spark: SparkSession, d: str) -> DataFrame:
    top = ranking.top_rows(cells(spark, d), [*PAIR, "seed_id"], "score", "ligand_id", 0.1)
    b = top.where("seed_id = 's23'").select(*PAIR, "ligand_id", F.lit(1).alias("hit"))
    rows = top.where("seed_id = 's11'").select(*PAIR, "ligand_id").join(b, [*PAIR, "ligand_id"], "left").groupBy(*PAIR).agg(F.count("hit").alias("common"), F.count("*").alias("top_count"))
    return rows.select(*PAIR, F.lit(True).alias("compared"), "common", "top_count", (F.col("common") / F.col("top_count")).alias("overlap"))


@query(
    """WITH r AS (SELECT target_id, receptor_id, ligand_id, avg(rn) OVER (PARTITION BY target_id, receptor_id, median_score) AS rk, median_score FROM (SELECT *, row_number() OVER (PARTITION BY target_id, receptor_id ORDER BY median_score) AS rn FROM summary))
 SELECT a.target_id, a.receptor_id AS a, b.receptor_id AS b, count(*) AS common, round(avg(least(a.median_score, b.median_score)), 9) AS mean_least, round(CASE WHEN var_pop(a.rk) * count(*) > 1e-18 AND var_pop(b.rk) * count(*) > 1e-18 THEN 1 - abs(covar_pop(a.rk, b.rk) / sqrt(var_pop(a.rk) * var_pop(b.rk))) END, 5) AS complementarity FROM r a JOIN r b ON a.target_id = b.target_id AND a.ligand_id = b.ligand_id AND a.receptor_id < b.receptor_id GROUP BY ALL""",
    "summary",
)
def pair_complementarity(spark: SparkSession, d: str) -> DataFrame:
    rows = summary(spark, d).select(*PAIR, "ligand_id", "median_score")
    ranks = ranking.value_ranks(rows, PAIR, "median_score").select(*PAIR, "median_score", (F.col("less") + (F.col("equal") + 1) / 2).alias("rk"))
    full = rows.join(ranks, [*PAIR, "median_score"])
    a = full.select("target_id", "ligand_id", F.col("receptor_id").alias("a"), F.col("median_score").alias("sa"), F.col("rk").alias("ra"))
    b = full.select("target_id", "ligand_id", F.col("receptor_id").alias("b"), F.col("median_score").alias("sb"), F.col("rk").alias("rb"))
    both = a.join(b, ["target_id", "ligand_id"]).where("a < b")
    return both.groupBy("target_id", "a", "b").agg(F.count("*").alias("common"), F.avg(F.least("sa", "sb")).alias("mean_least"), F.round(1 - F.abs(ranking.pearson(F.col("ra"), F.col("rb"))), 5).alias("complementarity"))

