"""Queries over what follows from scores: sets, normalizations, folds, resampling, subsets, geometry, sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions.numbers import settled
from scorelake.functions.text import folded, trimmed
from scorelake.operators import folds, geometry, normalize, ranking, resampling, series, sets, subsets
from scorelake.operators.prefix import row_numbers, running_totals
from scorelake.plans.base import cells, labelled, labels, members, query, stored_labelled, summary
from scorelake.plans.score_queries import _SPLIT, _TOPSEED, screening_metrics_by_replicate, split_of
from scorelake.plans.spelling import folded_sql, trim_sql
from scorelake.sources.tables import table
from scorelake.storage import materialize

PAIR = ["target_id", "receptor_id"]


def _top(rows: DataFrame) -> DataFrame:
    return ranking.top_rows(rows.select(*PAIR, "ligand_id", "median_score", "y"), PAIR, "median_score", "ligand_id", 0.1)


# Sets


@query("WITH s AS (SELECT target_id, receptor_id, count(*) AS n FROM top GROUP BY ALL), c AS (SELECT x.target_id, x.receptor_id AS a, z.receptor_id AS b, count(*) AS common FROM top x JOIN top z ON x.target_id = z.target_id AND x.ligand_id = z.ligand_id AND x.receptor_id < z.receptor_id GROUP BY ALL), p AS (SELECT sa.target_id, sa.receptor_id AS a, sb.receptor_id AS b, sa.n AS size_a, sb.n AS size_b FROM s sa JOIN s sb ON sa.target_id = sb.target_id AND sa.receptor_id < sb.receptor_id) SELECT target_id, a, b, size_a, size_b, coalesce(common, 0) AS common, size_a + size_b - coalesce(common, 0) AS either, round(coalesce(common, 0) * 1.0 / (size_a + size_b - coalesce(common, 0)), 9) AS jaccard FROM p LEFT JOIN c USING (target_id, a, b)", "top")
def hit_set_pairs(spark: SparkSession, d: str) -> DataFrame:
    return sets.set_pairs(_top(labelled(spark, d)), ["target_id"], "receptor_id", "ligand_id")


@query("WITH w AS (SELECT target_id, count(*) FILTER (y = 1) AS a, count(*) FILTER (y = 0) AS n FROM (SELECT DISTINCT target_id, ligand_id, y FROM lab) GROUP BY ALL) SELECT target_id, receptor_id, count(*) FILTER (y = 1) AS hit_actives, count(*) FILTER (y = 0) AS hit_decoys, round(count(*) FILTER (y = 1) * 1.0 / nullif(any_value(a), 0), 9) AS reward, round(count(*) FILTER (y = 0) * 1.0 / nullif(any_value(n), 0), 9) AS exposure FROM top JOIN w USING (target_id) GROUP BY ALL", "top")
def coverage_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = stored_labelled(spark, d)
    return sets.coverage(_top(rows), rows.select("target_id", "ligand_id", "y").distinct(), ["target_id"], "receptor_id")


@query(f"WITH t AS ({_TOPSEED}) SELECT target_id, receptor_id, ligand_id, count(DISTINCT seed_id) AS hits, count(DISTINCT seed_id) * 2 > any_value(k) AS majority, count(DISTINCT seed_id) = any_value(k) AS every FROM t JOIN (SELECT target_id, receptor_id, count(DISTINCT seed_id) AS k FROM t GROUP BY ALL) w USING (target_id, receptor_id) GROUP BY ALL", "cells")
def seed_consensus(spark: SparkSession, d: str) -> DataFrame:
    hits = materialize(ranking.top_rows(cells(spark, d), [*PAIR, "seed_id"], "score", "ligand_id", 0.1), "hits")
    return sets.replicate_consensus(hits, PAIR, "ligand_id", "seed_id")


@query("WITH b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id, seed_id ORDER BY roc_auc DESC NULLS LAST, receptor_id) AS k FROM seedmetrics) WHERE k <= 5), r AS (SELECT target_id, count(DISTINCT seed_id) AS runs FROM b GROUP BY ALL) SELECT target_id, receptor_id, count(DISTINCT seed_id) AS held, round(count(DISTINCT seed_id) * 1.0 / any_value(runs), 9) AS frequency, count(DISTINCT seed_id) * 1.0 / any_value(runs) >= 0.5 - 1e-12 AS stable FROM b JOIN r USING (target_id) GROUP BY ALL", "seedmetrics")
def inclusion_frequency(spark: SparkSession, d: str) -> DataFrame:
    rows = screening_metrics_by_replicate(spark, d).withColumn("roc_auc", settled("roc_auc"))
    best = ranking.best_groups(rows, ["target_id", "seed_id"], [F.desc_nulls_last("roc_auc"), F.asc("receptor_id")], 5)
    return sets.inclusion(best, ["target_id"], "seed_id", "receptor_id", 0.5)


# Normalizations


@query(f"WITH s AS (SELECT *, {_SPLIT} AS split FROM summary), b AS (SELECT target_id, receptor_id, min(median_score) AS lo, max(median_score) AS hi FROM s WHERE split = 'train' GROUP BY ALL) SELECT target_id, receptor_id, ligand_id, split, median_score, round(CASE WHEN lo IS NOT NULL THEN CASE WHEN hi = lo THEN 0 ELSE (median_score - lo) / (hi - lo) END END, 9) AS scaled FROM s LEFT JOIN b USING (target_id, receptor_id)", "summary")
def train_minmax(spark: SparkSession, d: str) -> DataFrame:
    rows = summary(spark, d).select(*PAIR, "ligand_id", "median_score").withColumn("split", split_of("ligand_id"))
    return normalize.train_minmax(rows.where("split = 'train'"), rows, PAIR, "median_score")


@query("WITH m AS (SELECT target_id, receptor_id, round(avg(median_score), 9) AS value FROM summary GROUP BY ALL), s AS (SELECT target_id, min(value) AS lo, max(value) AS hi, max(abs(value)) AS big, avg(value) AS mean, stddev_pop(value) AS sd FROM m GROUP BY ALL) SELECT target_id, receptor_id, value, round(CASE WHEN hi = lo THEN 0 ELSE (value - lo) / (hi - lo) END, 8) AS minmax, round(CASE WHEN big = 0 THEN 0 ELSE value / big END, 8) AS maxabs, round(CASE WHEN sd < 1e-12 THEN 0 ELSE (value - mean) / sd END, 8) AS zscore FROM m JOIN s USING (target_id)", "summary")
def scaled_terms(spark: SparkSession, d: str) -> DataFrame:
    means = summary(spark, d).groupBy(*PAIR).agg(settled(F.avg("median_score")).alias("value"))
    rows = normalize.scale_terms(means, ["target_id"], "value")
    return rows.select(*means.columns, *(F.round(c, 8).alias(c) for c in ("minmax", "maxabs", "zscore")))


@query("SELECT conformer_id, pool_id, source_type, c.resolution_angstrom, round(coalesce(c.resolution_angstrom, m), 9) AS imputed FROM conformers c LEFT JOIN (SELECT source_type AS st, median(resolution_angstrom) AS m FROM conformers GROUP BY ALL) ON source_type IS NOT DISTINCT FROM st")
def impute_median(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conformers").select("conformer_id", "pool_id", "source_type", "resolution_angstrom")
    return normalize.impute_median(rows, ["source_type"], "resolution_angstrom", "imputed")


@query(
    """WITH o AS (SELECT target_id, ligand_id, median_score AS v, row_number() OVER (PARTITION BY target_id, ligand_id ORDER BY median_score) AS r FROM summary)
 SELECT target_id, ligand_id, count(*) AS scorers, min(v) AS least, round(avg(v), 9) AS mean, round(avg(v) FILTER (r <= 2), 9) AS best_two_mean,
 round(CASE WHEN count(*) FILTER (v = 0) > 0 THEN 0 WHEN count(*) FILTER (v < 0) = 0 THEN exp(avg(ln(abs(nullif(v, 0))))) WHEN count(*) FILTER (v < 0) = count(*) OR (count(*) % 2 = 1 AND count(*) FILTER (v < 0) % 2 = 1) THEN -exp(avg(ln(abs(nullif(v, 0))))) WHEN count(*) % 2 = 1 THEN exp(avg(ln(abs(nullif(v, 0))))) END, 9) AS geometric FROM o GROUP BY ALL""",
    "summary",
)
def consensus_scores(spark: SparkSession, d: str) -> DataFrame:
    return normalize.consensus(summary(spark, d), ["target_id", "ligand_id"], "median_score")


# Folds


@query("SELECT target_id, ligand_id, y, CAST((row_number() OVER (PARTITION BY target_id, y ORDER BY sha256('fold|' || ligand_id), ligand_id) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT target_id, ligand_id, y FROM lab)", "lab")
def hash_folds(spark: SparkSession, d: str) -> DataFrame:
    return folds.hash_folds(labelled(spark, d).select("target_id", "ligand_id", "y").distinct(), ["target_id", "y"], "ligand_id", 5, "fold")


@query("SELECT target_id, ligand_id, y, CASE WHEN r <= floor(n * CAST(0.6 AS DOUBLE) + 0.5) THEN 'train' WHEN r <= floor(n * CAST(0.6 AS DOUBLE) + 0.5) + floor(n * CAST(0.2 AS DOUBLE) + 0.5) THEN 'validation' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY target_id, y ORDER BY sha256('split|' || ligand_id), ligand_id) AS r, count(*) OVER (PARTITION BY target_id, y) AS n FROM (SELECT DISTINCT target_id, ligand_id, y FROM lab))", "lab")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return folds.stratified_split(labelled(spark, d).select("target_id", "ligand_id", "y").distinct(), ["target_id", "y"], "ligand_id", 0.6, 0.2, "split")


@query("SELECT y, split_group_id, ligand_id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY h, ligand_id) AS r FROM (SELECT y, split_group_id, arg_min(ligand_id, (sha256('panel|' || ligand_id), ligand_id)) AS ligand_id, min(sha256('panel|' || ligand_id)) AS h FROM labels GROUP BY ALL)) WHERE r <= 15", "labels")
def panel_sample(spark: SparkSession, d: str) -> DataFrame:
    return folds.sample_per_stratum(labels(spark, d), ["y"], "split_group_id", "ligand_id", 15, "panel")


@query("SELECT y, split_group_id, size, rows_before FROM (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY y ORDER BY h, split_group_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rows_before FROM (SELECT y, split_group_id, count(*) AS size, sha256('fill|' || split_group_id) AS h FROM labels WHERE split_group_id IS NOT NULL GROUP BY ALL)) WHERE rows_before < 40", "labels")
def budget_fill(spark: SparkSession, d: str) -> DataFrame:
    return folds.fill_by_groups(labels(spark, d).where("split_group_id IS NOT NULL"), ["y"], "split_group_id", 40, "fill")


@query("SELECT upper(trim(split_group_id)) AS split_group_id, count(DISTINCT outer_fold) AS folds, count(*) AS members FROM ligands WHERE split_group_id IS NOT NULL AND outer_fold IS NOT NULL GROUP BY ALL HAVING count(DISTINCT outer_fold) > 1")
def crossing_groups(spark: SparkSession, d: str) -> DataFrame:
    return folds.crossing_groups(table(spark, d, "ligands").select(F.upper(F.trim("split_group_id")).alias("split_group_id"), "outer_fold"), "split_group_id", "outer_fold")


@query("SELECT y, split_group_id, size, CAST(CASE WHEN (r - 1) // 5 % 2 = 0 THEN (r - 1) % 5 ELSE 4 - (r - 1) % 5 END AS INTEGER) AS fold FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY size DESC, split_group_id) AS r FROM (SELECT y, split_group_id, count(*) AS size FROM labels WHERE split_group_id IS NOT NULL GROUP BY ALL))", "labels")
def balanced_folds(spark: SparkSession, d: str) -> DataFrame:
    return folds.balanced_group_folds(labels(spark, d).where("split_group_id IS NOT NULL"), ["y"], "split_group_id", 5)


@query(f"WITH RECURSIVE e AS (SELECT DISTINCT ligand_id, k FROM (SELECT ligand_id, 'g' || split_group_id AS k FROM ligands UNION ALL SELECT ligand_id, 's' || {trim_sql('scaffold_smiles')} FROM ligands WHERE {folded_sql('scaffold_smiles')} IS NOT NULL) WHERE k IS NOT NULL), n AS (SELECT DISTINCT a.ligand_id AS a, b.ligand_id AS b FROM e a JOIN e b USING (k)), r AS (SELECT DISTINCT ligand_id, ligand_id AS g FROM ligands UNION SELECT n.b, r.g FROM r JOIN n ON n.a = r.ligand_id) SELECT ligand_id, min(g) AS group_key FROM r GROUP BY ALL")
def scaffold_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ligands").select("ligand_id", "split_group_id", F.when(folded(F.col("scaffold_smiles")).isNotNull(), trimmed(F.col("scaffold_smiles"))).alias("scaffold"))
    return folds.linked_groups(rows, "ligand_id", ["split_group_id", "scaffold"])


# Resampling

_U = "CAST('0x' || substr(sha256({}), 1, 12) AS BIGINT) / 281474976710656.0"
_W, _total, _term = "CASE", 0.0, 0.36787944117144233
for _k in range(8):
    _total += _term
    _W += f" WHEN u < CAST({_total!r} AS DOUBLE) THEN {_k}"
    _term /= _k + 1
_W += " ELSE 8 END"


@query(
    f"""WITH u AS (SELECT target_id, ligand_id, y, sum(median_score) AS s, count(*) AS n FROM lab GROUP BY ALL), x AS (SELECT *, {_W} AS w FROM (SELECT *, {_U.format("'boot|' || replicate || '|' || ligand_id")} AS u FROM u CROSS JOIN range(200) AS t(replicate))),
 g AS (SELECT target_id, replicate, sum(w * s) FILTER (y = 0) / nullif(sum(w * n) FILTER (y = 0), 0) - sum(w * s) FILTER (y = 1) / nullif(sum(w * n) FILTER (y = 1), 0) AS gap FROM x GROUP BY ALL) SELECT target_id, count(gap) AS valid, round(avg(gap), 9) AS mean_gap, round(quantile_cont(gap, 0.025), 9) AS low, round(quantile_cont(gap, 0.975), 9) AS high FROM g GROUP BY ALL""",
    "lab",
)
def bootstrap_gap(spark: SparkSession, d: str) -> DataFrame:
    return resampling.bootstrap_gap(labelled(spark, d), ["target_id"], "ligand_id", "y", "median_score", 200, "boot")


@query(
    f"""WITH b AS (SELECT target_id, block, sum(median_score) FILTER (y = 0) AS s0, count(*) FILTER (y = 0) AS n0, sum(median_score) FILTER (y = 1) AS s1, count(*) FILTER (y = 1) AS n1 FROM (SELECT *, floor({_U.format("'jack|' || ligand_id")} * 8) AS block FROM lab) GROUP BY ALL), t AS (SELECT target_id, sum(s0) AS a, sum(n0) AS c, sum(s1) AS e, sum(n1) AS f FROM b GROUP BY ALL),
 p AS (SELECT target_id, a / nullif(c, 0) - e / nullif(f, 0) AS gap, (a - coalesce(s0, 0)) / nullif(c - n0, 0) - (e - coalesce(s1, 0)) / nullif(f - n1, 0) AS part FROM b JOIN t USING (target_id)), m AS (SELECT target_id, median(part) AS med FROM p GROUP BY ALL)
 SELECT target_id, round(any_value(gap), 9) AS gap, round(any_value(med), 9) AS median_part, round(median(abs(part - med)), 9) AS mad, round(avg(CAST(CASE WHEN part IS NOT NULL AND gap IS NOT NULL THEN sign(part) = sign(gap) END AS INTEGER)), 9) AS sign_support FROM p JOIN m USING (target_id) GROUP BY ALL""",
    "lab",
)
def jackknife_gap(spark: SparkSession, d: str) -> DataFrame:
    return resampling.jackknife_gap(labelled(spark, d), ["target_id"], "ligand_id", "y", "median_score", 8, "jack")


@query(
    f"""WITH u AS (SELECT target_id, ligand_id, y, avg(median_score) AS v FROM lab GROUP BY ALL), w AS (SELECT target_id, sum(y) AS p, avg(v) FILTER (y = 0) - avg(v) FILTER (y = 1) AS gap FROM u GROUP BY ALL), r AS (SELECT target_id, replicate, v, row_number() OVER (PARTITION BY target_id, replicate ORDER BY {_U.format("'perm|' || replicate || '|' || ligand_id")}, ligand_id) AS r FROM u CROSS JOIN range(99) AS t(replicate)),
 g AS (SELECT target_id, replicate, avg(v) FILTER (r > p) - avg(v) FILTER (r <= p) AS g FROM r JOIN w USING (target_id) GROUP BY ALL) SELECT target_id, round(any_value(gap), 9) AS gap, count(g) AS permutations, round((1 + count(*) FILTER (g >= gap - 1e-9)) * 1.0 / (1 + count(g)), 9) AS p_value FROM g JOIN w USING (target_id) GROUP BY ALL""",
    "lab",
)
def permutation_test(spark: SparkSession, d: str) -> DataFrame:
    return resampling.permutation_gap(labelled(spark, d), ["target_id"], "ligand_id", "y", "median_score", 99, "perm")


# Subsets

_EVERY = "SELECT DISTINCT target_id, receptor_id FROM lab"
_COEF = """rows AS (SELECT target_id, receptor_id, ligand_id, median_score, y FROM lab), lin AS (SELECT target_id, receptor_id, avg(median_score) AS mean, round(coalesce(avg(median_score) FILTER (y = 0) - avg(median_score) FILTER (y = 1), 0), 9) AS gap FROM rows GROUP BY ALL),
 sg AS (SELECT r.target_id, r.receptor_id, r.ligand_id, r.median_score < lin.mean AS low FROM rows r JOIN lin USING (target_id, receptor_id)), quad AS (SELECT x.target_id, x.receptor_id AS a, z.receptor_id AS b, round(avg(CASE WHEN x.low = z.low THEN 1.0 ELSE 0.0 END), 9) AS agreement, count(*) AS common FROM sg x JOIN sg z ON x.target_id = z.target_id AND x.ligand_id = z.ligand_id AND x.receptor_id < z.receptor_id GROUP BY ALL)"""


def _coefficients(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Stored coefficients of every receptor and pair of receptors; small beside the scores they come from."""
    linear, pairs = subsets.coefficients(stored_labelled(spark, d), ["target_id"], "receptor_id", "ligand_id", "median_score", "y")
    return materialize(linear.withColumn("gap", settled("gap")), "linear"), materialize(pairs.withColumn("agreement", settled("agreement")), "pairs")


@query(f"WITH every AS ({_EVERY}) SELECT a.target_id, a.receptor_id AS m1, b.receptor_id AS m2, c.receptor_id AS m3, a.receptor_id || '+' || b.receptor_id || '+' || c.receptor_id AS subset FROM every a JOIN every b ON a.target_id = b.target_id AND a.receptor_id < b.receptor_id JOIN every c ON c.target_id = b.target_id AND b.receptor_id < c.receptor_id", "lab")
def receptor_subsets(spark: SparkSession, d: str) -> DataFrame:
    return subsets.enumerate_subsets(labelled(spark, d).select(*PAIR), ["target_id"], "receptor_id", 3)


@query(f"WITH {_COEF} SELECT target_id, receptor_id AS a, '' AS b, gap AS value FROM lin UNION ALL SELECT target_id, a, b, agreement FROM quad", "lab")
def coefficient_table(spark: SparkSession, d: str) -> DataFrame:
    linear, pairs = _coefficients(spark, d)
    return linear.select("target_id", F.col("receptor_id").alias("a"), F.lit("").alias("b"), F.col("gap").alias("value")).unionAll(pairs.select("target_id", "a", "b", F.col("agreement").alias("value")))


_ENERGY = """en AS (SELECT p.target_id, p.receptor_id || '+' || q.receptor_id || '+' || s.receptor_id AS subset, round(-p.gap - q.gap - s.gap + 0.5 * (coalesce(x.agreement, 0) + coalesce(w.agreement, 0) + coalesce(z.agreement, 0)), 9) AS energy FROM lin p JOIN lin q ON p.target_id = q.target_id AND p.receptor_id < q.receptor_id JOIN lin s ON s.target_id = q.target_id AND q.receptor_id < s.receptor_id
 LEFT JOIN quad x ON x.target_id = p.target_id AND x.a = p.receptor_id AND x.b = q.receptor_id LEFT JOIN quad w ON w.target_id = p.target_id AND w.a = p.receptor_id AND w.b = s.receptor_id LEFT JOIN quad z ON z.target_id = p.target_id AND z.a = q.receptor_id AND z.b = s.receptor_id)"""


@query(f"WITH {_COEF}, {_ENERGY} SELECT * FROM en", "lab")
def subset_energies(spark: SparkSession, d: str) -> DataFrame:
    linear, pairs = _coefficients(spark, d)
    picked = subsets.enumerate_subsets(linear, ["target_id"], "receptor_id", 3)
    return subsets.subset_energy(picked, linear, pairs, ["target_id"], "receptor_id", 3, 0.5).withColumn("energy", settled("energy"))


@query(f"WITH {_COEF}, {_ENERGY} SELECT target_id, arg_min(subset, (energy, subset)) AS subset, min(energy) AS energy, count(*) AS states FROM en GROUP BY ALL", "lab")
def exact_subset(spark: SparkSession, d: str) -> DataFrame:
    best = subset_energies(spark, d).groupBy("target_id").agg(F.min(F.struct("energy", "subset")).alias("b"), F.count("*").alias("states"))
    return best.select("target_id", "b.subset", "b.energy", "states")


@query()
def greedy_subset(spark: SparkSession, d: str) -> DataFrame:
    linear, pairs = _coefficients(spark, d)
    return subsets.greedy_path(linear, pairs, ["target_id"], "receptor_id", 3, 0.5)


@query("SELECT target_id, fold, k, round(value, 9) AS value FROM profile", "profile")
def size_profile(spark: SparkSession, d: str) -> DataFrame:
    """Per target and replicate: the mean of its k best receptors, for every k."""
    rows = screening_metrics_by_replicate(spark, d).where("roc_auc IS NOT NULL").select("target_id", "seed_id", "receptor_id", settled("roc_auc").alias("roc_auc")).withColumn("loss", -F.col("roc_auc"))
    along = running_totals(rows, ["target_id", "seed_id"], ["loss", "receptor_id"], {"before": None, "total": "roc_auc"})
    k = F.col("before") + 1
    return along.select("target_id", F.col("seed_id").alias("fold"), k.cast("int").alias("k"), settled((F.col("total") + F.col("roc_auc")) / k).alias("value"))


@query("WITH e AS (SELECT target_id, k, round(avg(round(value, 9)), 8) AS mean, round(coalesce(stddev_samp(round(value, 9)) / sqrt(count(*)), 0), 8) AS error FROM profile GROUP BY ALL), b AS (SELECT target_id, arg_max(struct_pack(m := mean, s := error), (mean, -k)) AS b FROM e GROUP BY ALL) SELECT target_id, min(k) AS chosen_k FROM e JOIN b USING (target_id) WHERE mean >= b.m - b.s - 1e-7 GROUP BY ALL", "profile")
def one_standard_error(spark: SparkSession, d: str) -> DataFrame:
    return subsets.one_standard_error(size_profile(spark, d), ["target_id"], "k", "value")


@query("WITH p AS (SELECT target_id, fold, k, round(value, 9) AS value FROM profile), g AS (SELECT a.target_id, a.k, avg(a.value - b.value) AS mean_gain, coalesce(stddev_samp(a.value - b.value) / sqrt(count(*)), 0) AS error FROM p a JOIN p b ON a.target_id = b.target_id AND a.fold = b.fold AND a.k = b.k + 1 GROUP BY ALL) SELECT target_id, k, round(mean_gain, 8) AS mean_gain, round(error, 8) AS error, bool_and(mean_gain - error > 0) OVER (PARTITION BY target_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS go_on FROM g", "profile")
def marginal_stop(spark: SparkSession, d: str) -> DataFrame:
    rows = subsets.marginal_stop(size_profile(spark, d), ["target_id"], "fold", "k", "value")
    return rows.withColumns({c: F.round(c, 8) for c in ("mean_gain", "error")})


# Geometry


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return geometry.clean_pairs(table(spark, d, "conformer_distances"), "conformer_id_a", "conformer_id_b", "standardized_pocket_distance")


@query("SELECT a, b, distance FROM pairs", "pairs")
def clean_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d)


@query("SELECT CAST(sum(n) AS BIGINT) AS row_count, CAST(coalesce(sum(n) FILTER (self), 0) AS BIGINT) AS self_pairs, CAST(sum(missing) AS BIGINT) AS missing_distances, count(*) FILTER (NOT self) AS pairs, count(*) FILTER (NOT self AND n > 1) AS repeated_pairs FROM (SELECT least(conformer_id_a, conformer_id_b) AS x, greatest(conformer_id_a, conformer_id_b) AS z, conformer_id_a = conformer_id_b AS self, count(*) AS n, count(*) FILTER (standardized_pocket_distance IS NULL OR isnan(standardized_pocket_distance)) AS missing FROM conformer_distances GROUP BY ALL)")
def pair_audit(spark: SparkSession, d: str) -> DataFrame:
    return geometry.pair_audit(table(spark, d, "conformer_distances"), "conformer_id_a", "conformer_id_b", "standardized_pocket_distance")


@query("SELECT a, b, distance, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS r FROM twoway) WHERE r <= 5", "twoway")
def nearest_conformers(spark: SparkSession, d: str) -> DataFrame:
    return geometry.nearest(_pairs(spark, d), 5)


@query("SELECT cluster, arg_min(a, (m, a)) AS medoid, min(m) AS mean_distance FROM (SELECT p.cluster, a, round(avg(distance), 9) AS m FROM twoway JOIN members p ON p.id = a JOIN members q ON q.id = b WHERE p.cluster = q.cluster GROUP BY ALL) GROUP BY ALL", "twoway members")
def cluster_medoids(spark: SparkSession, d: str) -> DataFrame:
    return geometry.medoids(_pairs(spark, d), members(spark, d))


@query("WITH f AS (SELECT a, q.cluster AS other, avg(distance) AS m FROM twoway JOIN members q ON q.id = b GROUP BY ALL), o AS (SELECT id, cluster, max(m) FILTER (other = cluster) AS x, min(m) FILTER (other <> cluster) AS z FROM members JOIN f ON f.a = id GROUP BY ALL) SELECT id, cluster, round(CASE WHEN x IS NULL THEN 0 ELSE (z - x) / nullif(greatest(x, z), 0) END, 9) AS silhouette FROM o", "twoway members")
def cluster_silhouettes(spark: SparkSession, d: str) -> DataFrame:
    return geometry.silhouettes(_pairs(spark, d), members(spark, d))


@query("WITH RECURSIVE s AS (SELECT a, arg_min(b, (distance, b)) AS successor FROM twoway JOIN members p ON p.id = a JOIN members q ON q.id = b WHERE q.quality < p.quality GROUP BY ALL), m AS (SELECT id, coalesce(successor, id) AS successor FROM members LEFT JOIN s ON a = id WHERE quality IS NOT NULL), w AS (SELECT id, successor AS at FROM m UNION SELECT w.id, m.successor FROM w JOIN m ON m.id = w.at WHERE m.successor <> w.at), t AS (SELECT id FROM m WHERE successor = id) SELECT m.id, m.successor, w.at AS endpoint FROM m JOIN w ON w.id = m.id JOIN t ON t.id = w.at", "twoway members")
def successor_basins(spark: SparkSession, d: str) -> DataFrame:
    return geometry.successor_basins(_pairs(spark, d), members(spark, d))


_NEAR = 0.5
_NEAR_SQL = f"""pt AS (SELECT conformer_id || '#' || i AS id, pool_id, [f[3 * i + 1], f[3 * i + 2], f[3 * i + 3]] AS v FROM (SELECT *, unnest(range(len(f) // 3)) AS i FROM (SELECT conformer_id, min(pool_id) AS pool_id, max(pocket_features) AS f FROM conformers WHERE pocket_features IS NOT NULL GROUP BY conformer_id))),
 p AS (SELECT a.id AS a, b.id AS b, a.pool_id AS pool_a, b.pool_id AS pool_b, round(list_distance(a.v, b.v), 8) AS distance FROM pt a JOIN pt b ON a.id < b.id WHERE list_distance(a.v, b.v) <= CAST({_NEAR} AS DOUBLE))"""


def _points(spark: SparkSession, d: str) -> DataFrame:
    """Rows (id, pool_id, point): the 3-D points (triples of features) of every structure."""
    rows = table(spark, d, "conformers").where("pocket_features IS NOT NULL").groupBy("conformer_id").agg(F.max("pocket_features").alias("f"), F.min("pool_id").alias("pool_id"))
    triples = F.transform(F.sequence(F.lit(0), F.floor(F.size("f") / 3).cast("int") - 1), lambda i: F.slice("f", 3 * i + 1, 3))
    each = rows.where("size(f) >= 3").select("conformer_id", "pool_id", F.posexplode(triples).alias("i", "point"))
    return each.select(F.concat_ws("#", "conformer_id", "i").alias("id"), "pool_id", "point")


def _near_points(spark: SparkSession, d: str, *carried: str) -> DataFrame:
    return geometry.vectors_within(_points(spark, d), "id", "point", _NEAR, carried=carried).withColumn("distance", F.round("distance", 8))


@query(f"WITH {_NEAR_SQL} SELECT a, b, distance FROM p")
def range_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of points of any structures within a cutoff."""
    return _near_points(spark, d)


@query(f"WITH {_NEAR_SQL}, w AS (SELECT a AS id, pool_b AS pool_id, distance FROM p UNION ALL SELECT b, pool_a, distance FROM p) SELECT id, pool_id, count(*) AS near, min(distance) AS least, CASE WHEN min(distance) <= CAST(0.2 AS DOUBLE) THEN 'contact' ELSE 'near' END AS contact FROM w GROUP BY ALL")
def range_contacts(spark: SparkSession, d: str) -> DataFrame:
    """Per point and pool of its neighbours within the cutoff: how many, the least distance, and its class."""
    ways = F.array(F.struct(F.col("a").alias("id"), F.col("pool_id_b").alias("pool_id")), F.struct(F.col("b").alias("id"), F.col("pool_id_a").alias("pool_id")))
    each = _near_points(spark, d, "pool_id").select(F.inline(ways), "distance")
    out = each.groupBy("id", "pool_id").agg(F.count("*").alias("near"), F.min("distance").alias("least"))
    return out.withColumn("contact", F.when(F.col("least") <= 0.2, "contact").otherwise("near"))


@query("SELECT label, CAST(i AS INTEGER) AS i, count(*) AS n, round(avg(x), 7) AS mean, round(stddev_pop(x), 7) AS fluctuation FROM (SELECT label, unnest(range(1, 65)) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY ALL")
def feature_fluctuation(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "e")).groupBy("label", "i")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(F.col("e").cast("double")), 7).alias("mean"), F.round(F.stddev_pop(F.col("e").cast("double")), 7).alias("fluctuation"))


# Sequences and summaries


@query("WITH x AS (SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events), r AS (SELECT user_id, event_type, g, count(*) AS n, min(ts) AS f, max(ts) AS l FROM x GROUP BY ALL) SELECT user_id, event_type, count(*) AS runs, max(n) AS longest_run, CAST(sum(n) AS BIGINT) AS occupancy, min(f) AS first_time, max(l) AS last_time, count(*) > 1 AS revisited FROM r GROUP BY ALL")
def state_runs(spark: SparkSession, d: str) -> DataFrame:
    return series.state_runs(table(spark, d, "events"), "user_id", "ts", "event_id", "event_type")


@query("WITH e AS (SELECT *, epoch_us(ts) / 86400000000.0 AS t FROM events) SELECT user_id, count(value) AS n, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value, round(CASE WHEN var_pop(t - m) > 0 THEN covar_pop(value, t - m) / var_pop(t - m) END, 6) AS slope_per_day, round(arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)), 9) AS delta FROM e JOIN (SELECT user_id, min(t) AS m FROM e GROUP BY ALL) USING (user_id) GROUP BY ALL")
def value_trends(spark: SparkSession, d: str) -> DataFrame:
    return series.trends(table(spark, d, "events"), ["user_id"], "ts", "value", "event_id").withColumn("slope_per_day", F.round("slope_per_day", 6))


@query("WITH o AS (SELECT target_id, ligand_id, receptor_id, min(score) AS own FROM cells GROUP BY ALL), s AS (SELECT *, min(own) OVER (PARTITION BY target_id, ligand_id ORDER BY receptor_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bf FROM o) SELECT target_id, receptor_id, count(*) AS seen, count(*) FILTER (bf IS NULL OR own < bf) AS improved, round(avg(least(own, coalesce(bf, own))), 9) AS mean_best FROM s GROUP BY ALL", "cells")
def sequential_reveal(spark: SparkSession, d: str) -> DataFrame:
    return series.reveal(cells(spark, d), ["target_id"], "ligand_id", "receptor_id", "score")


@query("WITH c AS (SELECT target_id, score, count(*) AS c FROM cells GROUP BY ALL), r AS (SELECT *, sum(c) OVER (PARTITION BY target_id ORDER BY score) AS upto, sum(c) OVER (PARTITION BY target_id) AS n FROM c) SELECT target_id, density, min(score) AS threshold FROM r CROSS JOIN (VALUES (CAST(0.01 AS DOUBLE)), (CAST(0.05 AS DOUBLE)), (CAST(0.25 AS DOUBLE))) AS t(density) WHERE upto >= ceil(density * n) GROUP BY ALL", "cells")
def quality_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return series.histogram_thresholds(cells(spark, d), ["target_id"], "score", [0.01, 0.05, 0.25])


@query("WITH r AS (SELECT target_id, ligand_id, receptor_id, coalesce(min(score) FILTER (seed_id = 's11'), min(score)) AS ref FROM cells GROUP BY ALL) SELECT target_id, ligand_id, receptor_id, seed_id, score, ref AS reference_value, round(score - ref, 9) AS regret FROM cells JOIN r USING (target_id, ligand_id, receptor_id)", "cells")
def reference_regret(spark: SparkSession, d: str) -> DataFrame:
    return series.regret(cells(spark, d), ["target_id", "ligand_id", "receptor_id"], "seed_id", "score", "s11").select("target_id", "ligand_id", "receptor_id", "seed_id", "score", "reference_value", "regret")


@query("WITH p AS (SELECT target_id, ligand_id, receptor_id, min(score) FILTER (seed_id = 's11') - min(score) FILTER (seed_id = 's23') AS x FROM cells GROUP BY ALL) SELECT target_id, count(*) AS n, round(avg(x), 9) AS mean_delta, round(median(x), 9) AS median_delta, count(*) FILTER (x < 0) AS wins, count(*) FILTER (x = 0) AS ties, count(*) FILTER (x > 0) AS losses FROM p WHERE x IS NOT NULL GROUP BY ALL", "cells")
def paired_replicates(spark: SparkSession, d: str) -> DataFrame:
    return series.paired_comparison(cells(spark, d), ["ligand_id", "receptor_id"], ["target_id"], "seed_id", "score", "s11", "s23")


@query("WITH o AS (SELECT target_id, seed_id, avg(score) < -6.5 AS ok FROM cells GROUP BY ALL), t AS (SELECT seed_id, count(*) AS n, count(*) FILTER (ok) AS k FROM o GROUP BY ALL) SELECT x.target_id, min(z.seed_id) AS chosen FROM (SELECT DISTINCT target_id FROM o) x LEFT JOIN (SELECT o.target_id, o.seed_id FROM o JOIN t USING (seed_id) WHERE n > 1 AND k - CAST(ok AS INTEGER) = n - 1) z USING (target_id) GROUP BY ALL", "cells")
def leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    passed = cells(spark, d).groupBy("target_id", "seed_id").agg((F.avg("score") < -6.5).alias("ok"))
    return series.leave_one_out(passed, "target_id", "seed_id", "ok")


@query("WITH j AS (SELECT target_id, a.score AS x, b.score AS v, c.score AS z FROM (SELECT * FROM cells WHERE seed_id = 's11') a JOIN (SELECT * FROM cells WHERE seed_id = 's23') b USING (target_id, ligand_id, receptor_id) JOIN (SELECT * FROM cells WHERE seed_id = 's37') c USING (target_id, ligand_id, receptor_id)), f AS (SELECT target_id, count(*) AS n, var_pop(x) * count(*) + 1 AS aa, var_pop(v) * count(*) + 1 AS bb, covar_pop(x, v) * count(*) AS ab, covar_pop(x, z) * count(*) AS az, covar_pop(v, z) * count(*) AS bz, avg(x) AS ma, avg(v) AS mb, avg(z) AS mz FROM j GROUP BY ALL), g AS (SELECT *, (az * bb - bz * ab) / (aa * bb - ab * ab) AS s1, (bz * aa - az * ab) / (aa * bb - ab * ab) AS s2 FROM f) SELECT target_id, n, round(s1, 6) AS slope_1, round(s2, 6) AS slope_2, round(mz - s1 * ma - s2 * mb, 6) AS intercept FROM g", "cells")
def ridge_fit(spark: SparkSession, d: str) -> DataFrame:
    from scorelake.operators.scores import score_matrix

    wide = score_matrix(cells(spark, d), ["target_id", "ligand_id", "receptor_id"], "seed_id", ["s11", "s23", "s37"]).dropna()
    rows = series.linear_fit(wide, ["target_id"], ["s11", "s23"], "s37", 1.0)
    return rows.withColumns({c: F.round(c, 6) for c in ("slope_1", "slope_2", "intercept")})


@query("SELECT kind, received_month, count(*) AS record_count, count(*) FILTER (json_valid(record) AND json_extract(record, '$.receptors') IS NOT NULL AND json_type(record, '$.receptors') <> 'NULL') AS with_receptors, count(DISTINCT json_extract_string(record, '$.schema_version')) AS schema_versions FROM (SELECT *, strftime(received_at, '%Y-%m') AS received_month FROM run_records) GROUP BY ALL")
def record_overview(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "run_records").withColumn("received_month", F.date_format("received_at", "yyyy-MM"))
    return rows.groupBy("kind", "received_month").agg(F.count("*").alias("record_count"), F.count(F.get_json_object("record", "$.receptors")).alias("with_receptors"), F.countDistinct(F.get_json_object("record", "$.schema_version")).alias("schema_versions"))


@query("SELECT p_partkey, p_name, concat_ws(';', CASE WHEN regexp_matches(p_name, '(?i)red') THEN 'red' END, CASE WHEN regexp_matches(p_type, '(?i)steel') THEN 'steel' END, CASE WHEN regexp_matches(p_brand, '(?i)#1') THEN '#1' END) AS matched FROM part")
def title_exclusions(spark: SparkSession, d: str) -> DataFrame:
    hits = F.array_compact(F.array(*(F.when(F.col(c).rlike(f"(?i){x}"), x) for c, x in (("p_name", "red"), ("p_type", "steel"), ("p_brand", "#1")))))
    return table(spark, d, "part").select("p_partkey", "p_name", F.array_join(hits, ";").alias("matched"))


@query("SELECT o_orderkey, o_custkey, turn, row_number() OVER (ORDER BY turn, o_custkey) AS position FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS turn FROM orders)")
def round_robin_order(spark: SparkSession, d: str) -> DataFrame:
    """All orders interleaved: the first of every customer, then the second of every customer, and so on."""
    rows = row_numbers(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "turn")
    return row_numbers(rows.select("o_orderkey", "o_custkey", "turn"), [], ["turn", "o_custkey"], "position")


@query("SELECT n_name, r_name, c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL")
def manifest_join(spark: SparkSession, d: str) -> DataFrame:
    o, c, n, r = (table(spark, d, x) for x in ("orders", "customer", "nation", "region"))
    rows = o.join(c, F.col("c_custkey") == F.col("o_custkey")).join(n, F.col("n_nationkey") == F.col("c_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.groupBy("n_name", "r_name", "c_mktsegment").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))

