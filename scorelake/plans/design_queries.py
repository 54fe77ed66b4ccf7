"""Queries that tune, disturb and compare choices of scorers, and fills that meet a budget exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions.numbers import settled
from scorelake.functions.text import folded, trimmed
from scorelake.operators import folds, ranking, resampling, series, subsets
from scorelake.plans.base import cells, labelled, labels, members, query, stored_labelled
from scorelake.plans.derived_queries import _COEF, _EVERY, _U, _coefficients, nearest_conformers
from scorelake.plans.score_queries import best_receptors, flagged_pairs, screening_metrics, screening_metrics_by_replicate
from scorelake.plans.spelling import folded_sql, trim_sql
from scorelake.plans.subset_queries import _best3, _ranks, _utility
from scorelake.sources.tables import table
from scorelake.storage import materialize

PAIR = ["target_id", "receptor_id"]

# Scopes and gates


@query(
    f"""WITH s AS (SELECT ligand_id, min({trim_sql("scaffold_smiles")}) FILTER ({folded_sql("scaffold_smiles")} IS NOT NULL) AS scaffold FROM ligands GROUP BY ALL),
 e AS (SELECT target_id, split_group_id, ligand_id, y, round(median(median_score), 9) AS m FROM lab WHERE split_group_id IS NOT NULL GROUP BY ALL)
 SELECT target_id, split_group_id, count(*) AS ligands, count(*) FILTER (y = 1) AS actives, count(DISTINCT scaffold) AS scaffolds, round(median(m), 9) AS median_score,
 count(*) >= 3 AND count(DISTINCT scaffold) >= 2 AS passes FROM e LEFT JOIN s USING (ligand_id) GROUP BY ALL""",
    "lab",
)
def group_gates(spark: SparkSession, d: str) -> DataFrame:
    """Per target and group of ligands: the median of the ligands' medians, different scaffolds, and whether both are enough."""
    text = F.col("scaffold_smiles")
    scaffolds = table(spark, d, "ligands").groupBy("ligand_id").agg(F.min(F.when(folded(text).isNotNull(), trimmed(text))).alias("scaffold"))
    each = labelled(spark, d).where("split_group_id IS NOT NULL").groupBy("target_id", "split_group_id", "ligand_id", "y").agg(settled(F.median("median_score")).alias("m"))
    n, kinds = F.count("*"), F.countDistinct("scaffold")
    return each.join(scaffolds, "ligand_id", "left").groupBy("target_id", "split_group_id").agg(
        n.alias("ligands"), F.count_if(F.col("y") == 1).alias("actives"), kinds.alias("scaffolds"), F.median("m").alias("median_score"), ((n >= 3) & (kinds >= 2)).alias("passes")
    )


_FLAGS = ["nonnegative_score", "missing_replicate"]


@query(
    """SELECT * FROM (SELECT target_id, ligand_id, receptor_id, concat_ws(';', CASE WHEN maximum_score >= 0 THEN 'nonnegative_score' END, CASE WHEN score_range > CAST(0.5 AS DOUBLE) THEN 'seed_range' END,
 CASE WHEN replicate_count < 3 THEN 'missing_replicate' END) AS flag_reasons FROM summary) WHERE list_has_any(string_split(flag_reasons, ';'), ['nonnegative_score', 'missing_replicate'])""",
    "summary",
)
def warning_rows(spark: SparkSession, d: str) -> DataFrame:
    """Flagged pairs that have any of the wanted reasons."""
    rows = flagged_pairs(spark, d).select(*PAIR, "ligand_id", "flag_reasons")
    return rows.where(F.arrays_overlap(F.split("flag_reasons", ";"), F.array(*(F.lit(x) for x in _FLAGS))))


_PLAIN = r"^\s*[+-]?[0-9]+(\.[0-9]+)?\s*$"


@query(
    f"""SELECT target_id, count(*) AS row_count, count(*) FILTER (coalesce(trim(gpu_score), '') = '') AS blank, count(*) FILTER (regexp_matches(gpu_score, '{_PLAIN}')) AS parsed,
 count(*) FILTER (coalesce(trim(gpu_score), '') <> '' AND NOT regexp_matches(gpu_score, '{_PLAIN}')) AS bad, CAST(min(trunc(TRY_CAST(trim(gpu_score) AS DOUBLE))) FILTER (regexp_matches(gpu_score, '{_PLAIN}')) AS BIGINT) AS least,
 CAST(max(trunc(TRY_CAST(trim(gpu_score) AS DOUBLE))) FILTER (regexp_matches(gpu_score, '{_PLAIN}')) AS BIGINT) AS most FROM seed_scores_mirror GROUP BY ALL"""
)
def whole_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Per target: how many texts of a number field are blank, plain numbers or neither, and the ends of their whole parts."""
    c = F.col("gpu_score")
    plain, blank = F.coalesce(c.rlike(_PLAIN), F.lit(False)), F.coalesce(F.trim(c), F.lit("")) == ""
    whole = F.when(plain, F.trim(c).try_cast("double").cast("long"))
    return table(spark, d, "seed_scores_mirror").groupBy("target_id").agg(
        F.count("*").alias("row_count"), F.count_if(blank).alias("blank"), F.count_if(plain).alias("parsed"), F.count_if(~blank & ~plain).alias("bad"), F.min(whole).alias("least"), F.max(whole).alias("most")
    )


# Choices


@query(f"WITH {_COEF} SELECT target_id, receptor_id, gap, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY gap DESC, receptor_id) AS k FROM lin) WHERE k <= 3", "lab")
def linear_top_k(spark: SparkSession, d: str) -> DataFrame:
    """Per target: the three scorers of the best linear coefficients, the choice that pairs don't enter."""
    linear, _ = _coefficients(spark, d)
    return ranking.best_groups(linear.select(*PAIR, "gap"), ["target_id"], [F.desc("gap"), F.asc("receptor_id")], 3)


@query(
    """WITH c AS (SELECT target_id, receptor_id, count(*) AS contexts, round(avg(roc_auc), 9) AS auc, round(avg(average_precision), 9) AS ap, round(avg(bedroc), 9) AS early, round(coalesce(stddev_samp(roc_auc), 0), 9) AS spread, max(entity_count) AS size FROM seedmetrics WHERE roc_auc IS NOT NULL GROUP BY ALL)
 SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY auc DESC, ap DESC, early DESC, spread, size DESC, receptor_id) AS k FROM c) WHERE k = 1""",
    "seedmetrics",
)
def tuned_choice(spark: SparkSession, d: str) -> DataFrame:
    """Per target: the scorer that is best by six keys in turn over its replicates; ties of all end by id."""
    m = screening_metrics_by_replicate(spark, d).where("roc_auc IS NOT NULL").select(*PAIR, "entity_count", *(settled(c).alias(c) for c in ("roc_auc", "average_precision", "bedroc")))
    each = m.groupBy(*PAIR).agg(
        F.count("*").alias("contexts"), settled(F.avg("roc_auc")).alias("auc"), settled(F.avg("average_precision")).alias("ap"), settled(F.avg("bedroc")).alias("early"),
        settled(F.coalesce(F.stddev_samp("roc_auc"), F.lit(0.0))).alias("spread"), F.max("entity_count").alias("size"),
    )
    keys = F.struct(-F.col("auc"), -F.col("ap"), -F.col("early"), F.col("spread"), -F.col("size"), F.col("receptor_id"))
    return each.groupBy("target_id").agg(F.min_by(F.struct(*(c for c in each.columns if c != "target_id")), keys).alias("b")).select("target_id", "b.*")


@query(
    """WITH p AS (SELECT target_id, a.receptor_id || '+' || b.receptor_id AS subset, count(*) AS seeds, round(min(greatest(a.roc_auc, b.roc_auc)), 9) AS worst, round(avg(greatest(a.roc_auc, b.roc_auc)), 9) AS mean
 FROM seedmetrics a JOIN seedmetrics b USING (target_id, seed_id) WHERE a.receptor_id < b.receptor_id AND a.roc_auc IS NOT NULL AND b.roc_auc IS NOT NULL GROUP BY ALL)
 SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY seeds DESC, worst DESC, mean DESC, subset) AS k FROM p) WHERE k = 1""",
    "seedmetrics",
)
def balanced_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Per target: the pair of scorers whose better member is best in the worst replicate, then on average, among those with most replicates."""
    m = materialize(screening_metrics_by_replicate(spark, d).where("roc_auc IS NOT NULL").select(*PAIR, "seed_id", settled("roc_auc").alias("v")), "metrics")
    both = m.join(m.select("target_id", "seed_id", F.col("receptor_id").alias("b"), F.col("v").alias("w")), ["target_id", "seed_id"]).where("receptor_id < b")
    best = F.greatest("v", "w")
    each = both.groupBy("target_id", F.concat_ws("+", "receptor_id", "b").alias("subset")).agg(F.count("*").alias("seeds"), settled(F.min(best)).alias("worst"), settled(F.avg(best)).alias("mean"))
    keys = F.struct(-F.col("seeds"), -F.col("worst"), -F.col("mean"), F.col("subset"))
    return each.groupBy("target_id").agg(F.min_by(F.struct("subset", "seeds", "worst", "mean"), keys).alias("b")).select("target_id", "b.*")


@query("SELECT target_id, count(*) AS size, upper(substr(sha256(string_agg(receptor_id, '|' ORDER BY receptor_id)), 1, 20)) AS subset_id FROM best3 GROUP BY ALL", "best3")
def subset_ids(spark: SparkSession, d: str) -> DataFrame:
    """Per target: a name of the chosen scorers that doesn't depend on their order, from the SHA-256 of the sorted ids."""
    named = F.upper(F.substring(F.sha2(F.array_join(F.sort_array(F.collect_list("receptor_id")), "|"), 256), 1, 20))  # a chosen few
    return _best3(spark, d).groupBy("target_id").agg(F.count("*").alias("size"), named.alias("subset_id"))


@query(
    """WITH i AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY receptor_id) - 1 AS i, count(*) OVER (PARTITION BY target_id) AS n FROM best3), m AS (SELECT target_id, mask, receptor_id FROM i CROSS JOIN (SELECT CAST(unnest(range(1, 8)) AS INTEGER) AS mask) WHERE mask < (1 << n) AND (mask >> i) & 1 = 1),
 a AS (SELECT target_id, receptor_id, ligand_id FROM top WHERE y = 1) SELECT target_id, string_agg(DISTINCT receptor_id, '+' ORDER BY receptor_id) AS subset, count(DISTINCT receptor_id) AS size, count(DISTINCT ligand_id) AS covered FROM m LEFT JOIN a USING (target_id, receptor_id) GROUP BY target_id, mask""",
    "top best3",
)
def chosen_powerset(spark: SparkSession, d: str) -> DataFrame:
    """Every non-empty subset of a target's chosen scorers: actives that its members have in their top tenth."""
    hit = ranking.top_rows(stored_labelled(spark, d), PAIR, "median_score", "ligand_id", 0.1).where("y = 1").select(*PAIR, "ligand_id")
    sets = subsets.powerset(_best3(spark, d), ["target_id"], "receptor_id")
    out = sets.join(hit, PAIR, "left").groupBy("target_id", "mask").agg(F.array_join(F.sort_array(F.collect_set("receptor_id")), "+").alias("subset"), F.countDistinct("receptor_id").alias("size"), F.countDistinct("ligand_id").alias("covered"))
    return out.drop("mask")


@query(f"WITH e AS ({_EVERY}), p AS (SELECT target_id, a.receptor_id AS x, b.receptor_id AS z FROM e a JOIN e b USING (target_id) WHERE a.receptor_id < b.receptor_id) SELECT target_id, x || '+' || z AS subset, unnest([x, z, x || '*' || z]) AS term FROM p", "lab")
def design_terms(spark: SparkSession, d: str) -> DataFrame:
    """Members and pairs of every subset of two scorers, as rows of a sparse design matrix."""
    return subsets.design_terms(subsets.enumerate_subsets(labelled(spark, d), ["target_id"], "receptor_id", 2), ["target_id"], 2)


# Comparisons over replicates


@query(
    """WITH w AS (SELECT *, roc_auc = max(roc_auc) OVER (PARTITION BY target_id, seed_id) AS won FROM seedmetrics WHERE roc_auc IS NOT NULL)
 SELECT target_id, receptor_id, count(*) AS seeds, count(*) FILTER (won) AS wins, round(avg(roc_auc), 9) AS mean_auc, min(roc_auc) AS worst_auc FROM w GROUP BY ALL""",
    "seedmetrics",
)
def scorer_wins(spark: SparkSession, d: str) -> DataFrame:
    """Per scorer: replicates it was judged in, those in which none was better, mean and worst AUC."""
    m = materialize(screening_metrics_by_replicate(spark, d).where("roc_auc IS NOT NULL").select(*PAIR, "seed_id", settled("roc_auc").alias("v")), "metrics")
    best = m.groupBy("target_id", "seed_id").agg(F.max("v").alias("best"))
    return m.join(best, ["target_id", "seed_id"]).groupBy(*PAIR).agg(F.count("*").alias("seeds"), F.count_if(F.col("v") == F.col("best")).alias("wins"), F.avg("v").alias("mean_auc"), F.min("v").alias("worst_auc"))


@query(
    """WITH e AS (SELECT target_id, receptor_id, count(*) AS n, round(avg(roc_auc), 9) AS mean FROM seedmetrics WHERE roc_auc IS NOT NULL GROUP BY ALL), b AS (SELECT target_id, receptor_id, mean FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY n DESC, mean DESC, receptor_id) AS k FROM e) WHERE k = 1),
 f AS (SELECT target_id, seed_id, receptor_id AS own, roc_auc FROM (SELECT *, row_number() OVER (PARTITION BY target_id, seed_id ORDER BY roc_auc DESC, receptor_id) AS k FROM seedmetrics WHERE roc_auc IS NOT NULL) WHERE k = 1)
 SELECT target_id, receptor_id, mean AS mean_auc, count(*) AS seeds, count(*) FILTER (own <> receptor_id) AS seeds_lost, round(avg(roc_auc), 9) AS mean_of_best FROM b JOIN f USING (target_id) GROUP BY ALL""",
    "seedmetrics",
)
def target_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Per target: the best scorer over its replicates, how many replicates have another best one, and the mean of the replicates' best."""
    m = materialize(screening_metrics_by_replicate(spark, d).where("roc_auc IS NOT NULL").select(*PAIR, "seed_id", settled("roc_auc").alias("v")), "metrics")
    each = m.groupBy(*PAIR).agg(F.count("*").alias("n"), settled(F.avg("v")).alias("mean"))
    best = each.groupBy("target_id").agg(F.min(F.struct((-F.col("n")).alias("n"), (-F.col("mean")).alias("loss"), "receptor_id")).alias("b")).select("target_id", "b.receptor_id", (-F.col("b.loss")).alias("mean_auc"))
    own = m.groupBy("target_id", "seed_id").agg(F.min(F.struct((-F.col("v")).alias("loss"), "receptor_id")).alias("o"))
    return best.join(own, "target_id").groupBy(*PAIR, "mean_auc").agg(F.count("*").alias("seeds"), F.count_if(F.col("o.receptor_id") != F.col("receptor_id")).alias("seeds_lost"), F.avg(-F.col("o.loss")).alias("mean_of_best"))


@query(
    """WITH b AS (SELECT target_id, receptor_id, row_number() OVER (PARTITION BY target_id ORDER BY roc_auc DESC NULLS LAST, average_precision DESC NULLS LAST, receptor_id) AS k FROM metrics), s AS (SELECT target_id, ligand_id, y, seed_id, min(r) FILTER (k = 1) AS one, min(r) AS three FROM ranks JOIN b USING (target_id, receptor_id) WHERE k <= 3 GROUP BY ALL),
 m AS (SELECT target_id, ligand_id, y, coalesce(round(median(one), 9) <= CAST(0.1 AS DOUBLE), false) AS one, round(median(three), 9) <= CAST(0.1 AS DOUBLE) AS three FROM s GROUP BY ALL)
 SELECT target_id, count(*) FILTER (y = 1 AND three AND NOT one) AS actives_gained, count(*) FILTER (y = 1 AND one AND NOT three) AS actives_lost, count(*) FILTER (y = 0 AND three AND NOT one) AS decoys_gained, count(*) FILTER (y = 0 AND one AND NOT three) AS decoys_lost, count(*) FILTER (one AND three) AS kept, count(*) AS entities FROM m GROUP BY ALL""",
    "ranks metrics",
)
def subgroup_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per target: actives and decoys that come into or leave the first tenth (median over replicates of the best rank) when the best scorer gets two more beside it."""
    best = materialize(best_receptors(spark, d).select(*PAIR, "rank"), "best")
    by_seed = _ranks(spark, d).join(best, PAIR).groupBy("target_id", "ligand_id", "y", "seed_id").agg(F.min(F.when(F.col("rank") == 1, F.col("r"))).alias("one"), F.min("r").alias("three"))
    within = lambda c: F.coalesce(settled(F.median(c)) <= 0.1, F.lit(False))
    m = by_seed.groupBy("target_id", "ligand_id", "y").agg(within("one").alias("one"), within("three").alias("three"))
    of = lambda y, into: F.count_if((F.col("y") == y) & (F.col("three") == into) & (F.col("one") != into))
    return m.groupBy("target_id").agg(
        of(1, True).alias("actives_gained"), of(1, False).alias("actives_lost"), of(0, True).alias("decoys_gained"), of(0, False).alias("decoys_lost"), F.count_if(F.col("one") & F.col("three")).alias("kept"), F.count("*").alias("entities")
    )


@query(
    """WITH s AS (SELECT target_id, ligand_id, y, seed_id, count(*) FILTER (r <= CAST(0.1 AS DOUBLE)) AS k FROM ranks JOIN best3 USING (target_id, receptor_id) GROUP BY ALL), e AS (SELECT target_id, ligand_id, y, count(*) AS n, count(*) FILTER (k >= 1) AS single, count(*) FILTER (k >= 2) AS double FROM s GROUP BY ALL)
 SELECT target_id, count(*) FILTER (y = 1) AS actives, count(*) FILTER (y = 1 AND 2 * single > n) AS majority, count(*) FILTER (y = 1 AND single = n) AS every, count(*) FILTER (y = 1 AND 2 * double > n) AS double_support, count(*) FILTER (y = 0 AND 2 * single > n) AS decoy_exposure FROM e GROUP BY ALL""",
    "ranks best3",
)
def seed_support(spark: SparkSession, d: str) -> DataFrame:
    """Per target: actives that the chosen scorers have in their first tenth in most or all replicates, those that two of them have there in the same replicate in most, and decoys in most."""
    hits = _ranks(spark, d).join(_best3(spark, d), PAIR).groupBy("target_id", "ligand_id", "y", "seed_id").agg(F.count_if(F.col("r") <= 0.1).alias("k"))
    e = hits.groupBy("target_id", "ligand_id", "y").agg(F.count("*").alias("n"), F.count_if(F.col("k") >= 1).alias("single"), F.count_if(F.col("k") >= 2).alias("double"))
    when = lambda y, rule: F.count_if((F.col("y") == y) & F.expr(rule))
    return e.groupBy("target_id").agg(
        F.count_if(F.col("y") == 1).alias("actives"), when(1, "2 * single > n").alias("majority"), when(1, "single = n").alias("every"), when(1, "2 * double > n").alias("double_support"), when(0, "2 * single > n").alias("decoy_exposure")
    )


@query(
    """WITH j AS (SELECT a.target_id, a.ligand_id, a.score AS x, b.score AS z, l.y FROM cells a JOIN cells b USING (target_id, receptor_id, ligand_id) LEFT JOIN labels l USING (ligand_id) WHERE a.seed_id = 's11' AND b.seed_id = 's23')
 SELECT target_id, count(*) AS n, round(CASE WHEN var_pop(x) * count(*) > 1e-18 AND var_pop(z) * count(*) > 1e-18 THEN covar_pop(x, z) / sqrt(var_pop(x) * var_pop(z)) END, 5) AS pearson, round(avg(abs(x - z)), 9) AS mean_delta, round(median(abs(x - z)), 9) AS median_delta, round(quantile_cont(abs(x - z), 0.95), 9) AS q95_delta,
 round((avg(x) FILTER (y = 0) - avg(x) FILTER (y = 1)) - (avg(z) FILTER (y = 0) - avg(z) FILTER (y = 1)), 9) AS gap_delta FROM j GROUP BY ALL""",
    "cells labels",
)
def replicate_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Per target, of two replicates: correlation of the scores both have, quantiles of their differences, and by how much the gap between the classes differs."""
    rows = cells(spark, d)
    side = lambda seed, c: rows.where(F.col("seed_id") == seed).select(*PAIR, "ligand_id", F.col("score").alias(c))
    both = side("s11", "x").join(side("s23", "z"), [*PAIR, "ligand_id"]).join(labels(spark, d), "ligand_id", "left")
    x, z, y = F.col("x"), F.col("z"), F.col("y")
    gap = lambda c: F.avg(F.when(y == 0, c)) - F.avg(F.when(y == 1, c))
    delta = F.abs(x - z)
    return both.groupBy("target_id").agg(
        F.count("*").alias("n"), F.round(ranking.pearson(x, z), 5).alias("pearson"), F.avg(delta).alias("mean_delta"), F.median(delta).alias("median_delta"), F.percentile(delta, 0.95).alias("q95_delta"), (gap(x) - gap(z)).alias("gap_delta")
    )


@query(
    """WITH j AS (SELECT target_id, receptor_id, a.seed_id AS sa, b.seed_id AS sb, a.score AS x, b.score AS z FROM cells a JOIN cells b USING (target_id, receptor_id, ligand_id) WHERE a.seed_id < b.seed_id),
 r AS (SELECT target_id, receptor_id, sa, sb, avg(rx) OVER (PARTITION BY target_id, receptor_id, sa, sb, x) AS ax, avg(rz) OVER (PARTITION BY target_id, receptor_id, sa, sb, z) AS az FROM (SELECT *, row_number() OVER (PARTITION BY target_id, receptor_id, sa, sb ORDER BY x) AS rx, row_number() OVER (PARTITION BY target_id, receptor_id, sa, sb ORDER BY z) AS rz FROM j)),
 c AS (SELECT target_id, receptor_id, sa, sb, count(*) AS n, coalesce(CASE WHEN var_pop(ax) * count(*) > 1e-18 AND var_pop(az) * count(*) > 1e-18 THEN covar_pop(ax, az) / sqrt(var_pop(ax) * var_pop(az)) END, 0) AS rho FROM r GROUP BY ALL)
 SELECT target_id, receptor_id, count(*) AS seed_pairs, CAST(sum(n) AS BIGINT) AS compared, round(avg(rho), 5) AS mean_rho, round(min(rho), 5) AS least_rho FROM c GROUP BY ALL""",
    "cells",
)
def mean_spearman(spark: SparkSession, d: str) -> DataFrame:
    """Per scorer: mean and least rank correlation over all pairs of its replicates, on the entities both have; undefined ones count as 0."""
    rows = cells(spark, d)
    both = rows.select(*PAIR, "ligand_id", F.col("seed_id").alias("sa"), F.col("score").alias("x")).join(rows.select(*PAIR, "ligand_id", F.col("seed_id").alias("sb"), F.col("score").alias("z")), [*PAIR, "ligand_id"]).where("sa < sb")
    group = [*PAIR, "sa", "sb"]
    both = materialize(both.select(*group, "x", "z"), "both")
    for v in ("x", "z"):
        ranks = ranking.value_ranks(both.select(*group, v), group, v).select(*group, v, (F.col("less") + (F.col("equal") + 1) / 2).alias(f"a{v}"))
        both = both.join(ranks, [*group, v])
    each = both.groupBy(*group).agg(F.count("*").alias("n"), F.coalesce(ranking.pearson(F.col("ax"), F.col("az")), F.lit(0.0)).alias("rho"))
    return each.groupBy(*PAIR).agg(F.count("*").alias("seed_pairs"), F.sum("n").alias("compared"), F.round(F.avg("rho"), 5).alias("mean_rho"), F.round(F.min("rho"), 5).alias("least_rho"))


# Disturbances, held-out fits, exact fills


@query(
    f"""WITH {_COEF}, s AS (SELECT target_id, stddev_pop(gap) AS sd, arg_max(receptor_id, (gap, receptor_id)) AS best FROM lin GROUP BY ALL), v AS (SELECT target_id, level, draw, receptor_id, best, gap + level * sd * sqrt(-2 * ln(1 - {_U.format("'noise1|' || draw || '|' || target_id || '|' || receptor_id")})) * cos(2 * pi() * {_U.format("'noise2|' || draw || '|' || target_id || '|' || receptor_id")}) AS v
 FROM lin JOIN s USING (target_id) CROSS JOIN (SELECT unnest([CAST(0.05 AS DOUBLE), CAST(0.2 AS DOUBLE), CAST(0.5 AS DOUBLE)]) AS level) CROSS JOIN range(100) AS t(draw)), f AS (SELECT target_id, level, draw, any_value(best) AS best, arg_max(receptor_id, (v, receptor_id)) AS found FROM v GROUP BY ALL)
 SELECT target_id, level, any_value(best) AS best, count(*) AS draws, count(DISTINCT found) AS different, round(avg(CASE WHEN found = best THEN 1.0 ELSE 0.0 END), 9) AS share_kept FROM f GROUP BY ALL""",
    "lab",
)
def noise_robustness(spark: SparkSession, d: str) -> DataFrame:
    """Per target and level of noise on the linear coefficients: how often the best scorer stays the best in 100 draws."""
    linear, _ = _coefficients(spark, d)
    return resampling.noisy_choice(linear.select(*PAIR, "gap"), ["target_id"], "receptor_id", "gap", [0.05, 0.2, 0.5], 100, "noise")


@query(
    f"""WITH n AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS k FROM twoway) WHERE k = 1), i AS (SELECT pool_id, id, cluster AS label, row_number() OVER (PARTITION BY pool_id ORDER BY id) AS r FROM members),
 d AS (SELECT pool_id, id, replicate, row_number() OVER (PARTITION BY pool_id, replicate ORDER BY u, id) AS r FROM (SELECT pool_id, id, replicate, {_U.format("'near|' || replicate || '|' || id")} AS u FROM i CROSS JOIN range(99) AS t(replicate))), g AS (SELECT d.pool_id, d.id, d.replicate, i.label FROM d JOIN i USING (pool_id, r) UNION ALL SELECT pool_id, id, -1, label FROM i),
 e AS (SELECT g.pool_id, g.replicate, count(*) AS ids, count(*) FILTER (g.label = h.label) AS same FROM g JOIN n ON n.a = g.id JOIN g h ON h.id = n.b AND h.replicate = g.replicate GROUP BY ALL), o AS (SELECT pool_id, ids, same AS observed FROM e WHERE replicate = -1)
 SELECT pool_id, o.ids, observed, round(avg(same), 9) AS expected, count(*) AS permutations, round((1 + count(*) FILTER (same >= observed)) * 1.0 / (1 + count(*)), 9) AS p_value FROM e JOIN o USING (pool_id) WHERE replicate >= 0 GROUP BY pool_id, o.ids, observed""",
    "twoway members",
)
def permutation_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Per pool: conformers whose nearest neighbour is of their source type, against 99 permutations of the types within the pool."""
    ids = members(spark, d).select("pool_id", "id", F.col("cluster").alias("label"))
    return resampling.permutation_neighbours(nearest_conformers(spark, d).where("rank = 1").select("a", "b"), ids, ["pool_id"], 99, "near")


@query(
    """WITH x AS (SELECT target_id, utility AS x, roc_auc AS y FROM utility JOIN metrics USING (target_id, receptor_id) WHERE roc_auc IS NOT NULL), o AS (SELECT target_id, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM x GROUP BY ALL),
 t AS (SELECT sum(n) AS tn, sum(sx) AS tx, sum(sy) AS ty, sum(sxx) AS txx, sum(sxy) AS txy FROM o), r AS (SELECT target_id, n, tn - n AS m, tx - sx AS ax, ty - sy AS ay, txx - sxx AS axx, txy - sxy AS axy FROM o CROSS JOIN t),
 f AS (SELECT target_id, n, m, (axy - ax * ay / nullif(m, 0)) / (axx - ax * ax / nullif(m, 0) + CAST(0.01 AS DOUBLE)) AS slope, ax, ay FROM r), g AS (SELECT *, ay / m - slope * ax / m AS intercept FROM f)
 SELECT target_id, n AS n_held_out, CAST(any_value(m) AS BIGINT) AS n_fit, round(any_value(slope), 7) AS slope, round(any_value(intercept), 7) AS intercept, round(sqrt(avg((y - intercept - slope * x) * (y - intercept - slope * x))), 7) AS rmse FROM g JOIN x USING (target_id) GROUP BY target_id, n""",
    "utility metrics",
)
def left_out_fit(spark: SparkSession, d: str) -> DataFrame:
    """Per target: a ridge line from early-rank utility to AUC, fitted on the scorers of all other targets and judged on its own."""
    metrics = screening_metrics(spark, d).select(*PAIR, settled("roc_auc").alias("y"))
    fit = series.left_out_fit(_utility(_ranks(spark, d)).select(*PAIR, F.col("utility").alias("x")).join(metrics, PAIR), "target_id", "x", "y", 0.01)
    return fit.select("target_id", "n_held_out", "n_fit", *(F.round(c, 7).alias(c) for c in ("slope", "intercept", "rmse")))


@query(
    """WITH RECURSIVE s AS (SELECT y, split_group_id, size, row_number() OVER (PARTITION BY y ORDER BY sha256('exact|' || split_group_id), split_group_id) AS i FROM (SELECT y, split_group_id, count(*) AS size FROM labels WHERE split_group_id IS NOT NULL GROUP BY ALL)),
 go AS (SELECT y, CAST(0 AS BIGINT) AS i, CAST(40 AS BIGINT) AS room, CAST(NULL AS VARCHAR) AS split_group_id, CAST(0 AS BIGINT) AS size, false AS taken FROM (SELECT DISTINCT y FROM s) UNION ALL SELECT s.y, s.i, CASE WHEN s.size <= go.room THEN go.room - s.size ELSE go.room END, s.split_group_id, s.size, s.size <= go.room FROM go JOIN s ON s.y = go.y AND s.i = go.i + 1)
 SELECT y, split_group_id, size, room AS room_left FROM go WHERE taken""",
    "labels",
)
def exact_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per class: whole groups in hash order that fill 40 places without going over."""
    return folds.exact_fill(labels(spark, d), ["y"], "split_group_id", 40, "exact")
