"""Queries over chosen subsets of scorers, rank utilities, bootstrap draws of metrics, and validation of data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions.numbers import settled
from scorelake.operators import ranking, sets, subsets, utilities
from scorelake.plans.base import _metrics_sql, labelled_cells, labels, query, stored_labelled
from scorelake.plans.derived_queries import _U, _W, size_profile
from scorelake.plans.score_queries import _SPLIT, best_receptors, screening_metrics_by_replicate, split_of
from scorelake.sources.tables import table
from scorelake.storage import materialize

PAIR = ["target_id", "receptor_id"]
_CONSENSUS = "SELECT target_id, ligand_id, y, 'least' AS method, min(median_score) AS value FROM lab GROUP BY ALL UNION ALL SELECT target_id, ligand_id, y, 'mean', round(avg(median_score), 9) FROM lab GROUP BY ALL"


def _best3(spark: SparkSession, d: str) -> DataFrame:
    return materialize(best_receptors(spark, d).select(*PAIR), "best")


def _consensus(rows: DataFrame, keys: list[str]) -> DataFrame:
    both = rows.groupBy(*keys).agg(F.min("median_score").alias("least"), settled(F.avg("median_score")).alias("mean"))
    return both.unpivot(keys, ["least", "mean"], "method", "value")


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled_cells(spark, d).select(*PAIR, "seed_id", "ligand_id", "score", "y")
    return utilities.rank_shares(rows, [*PAIR, "seed_id"], "score", "ligand_id")


def _utility(ranks: DataFrame) -> DataFrame:
    return utilities.rank_utility(ranks, ["target_id"], "receptor_id", "seed_id").withColumn("utility", settled("utility"))


# Chosen subsets


@query(
    f"""WITH source AS (SELECT target_id, ligand_id, y, {_SPLIT} AS split, method, value FROM (SELECT target_id, ligand_id, y, 'least' AS method, min(median_score) AS value FROM lab JOIN best3 USING (target_id, receptor_id) GROUP BY ALL
 UNION ALL SELECT target_id, ligand_id, y, 'mean', round(avg(median_score), 9) FROM lab JOIN best3 USING (target_id, receptor_id) GROUP BY ALL)) {_metrics_sql("source", "target_id, method, split", "value")}""",
    "best3",
)
def subset_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Per target, split and method: metrics of the least and the mean score over a chosen subset of scorers, here the three best."""
    rows = stored_labelled(spark, d).join(_best3(spark, d), PAIR)
    values = _consensus(rows, ["target_id", "ligand_id", "y"]).withColumn("split", split_of("ligand_id"))
    return ranking.screening_metrics(values, ["target_id", "method", "split"], "value", "ligand_id", "y")


@query(
    f"""WITH source AS (SELECT x.target_id, x.receptor_id || '+' || z.receptor_id AS subset, x.ligand_id, x.y, least(x.median_score, z.median_score) AS value FROM lab x JOIN lab z ON x.target_id = z.target_id AND x.ligand_id = z.ligand_id AND x.receptor_id < z.receptor_id),
 m AS ({_metrics_sql("source", "target_id, subset", "value")}) SELECT target_id, subset, entity_count, roc_auc, bedroc, CAST(row_number() OVER (PARTITION BY target_id ORDER BY bedroc DESC NULLS LAST, subset) AS BIGINT) AS place FROM m""",
    "lab",
)
def pair_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of scorers of a target at once: metrics of the better score over the entities both scored, and the pair's place by BEDROC."""
    rows = stored_labelled(spark, d)
    b = rows.select("target_id", "ligand_id", F.col("receptor_id").alias("b"), F.col("median_score").alias("other"))
    pairs = rows.join(b, ["target_id", "ligand_id"]).where("receptor_id < b")
    values = pairs.select("target_id", F.concat_ws("+", "receptor_id", "b").alias("subset"), "ligand_id", "y", F.least("median_score", "other").alias("value"))
    metrics = ranking.screening_metrics(values, ["target_id", "subset"], "value", "ligand_id", "y").select("target_id", "subset", "entity_count", "roc_auc", settled("bedroc").alias("bedroc"))
    return ranking.best_groups(metrics, ["target_id"], [F.desc_nulls_last("bedroc"), F.asc("subset")], 1 << 30).withColumn("place", F.col("rank").cast("long")).drop("rank")


@query(
    f"""WITH source AS (SELECT target_id, ligand_id, y, series, value FROM (SELECT target_id, ligand_id, y, min(median_score) AS value, CAST(CAST('0x' || substr(sha256('series|' || ligand_id), 1, 12) AS BIGINT) % 3 AS INTEGER) AS own FROM lab GROUP BY ALL) CROSS JOIN (SELECT unnest([0, 1, 2]) AS series) WHERE y = 0 OR own = series),
 m AS ({_metrics_sql("source", "target_id, series", "value")}) SELECT target_id, count(roc_auc) AS evaluable, CASE WHEN count(roc_auc) = 3 THEN min(bedroc) END AS worst_bedroc, round(CASE WHEN count(roc_auc) = 3 THEN avg(bedroc) END, 8) AS mean_bedroc, round(avg(roc_auc), 8) AS mean_auc FROM m GROUP BY ALL""",
    "lab",
)
def group_holdout(spark: SparkSession, d: str) -> DataFrame:
    """Per target: metrics of each series of actives against all decoys; worst and mean are null unless all three series can be judged."""
    own = F.conv(F.substring(F.sha2(F.concat(F.lit("series|"), F.col("ligand_id")), 256), 1, 12), 16, 10).cast("long") % 3
    rows = stored_labelled(spark, d).groupBy("target_id", "ligand_id", "y").agg(F.min("median_score").alias("value"))
    wide = rows.withColumn("series", F.explode(F.when(F.col("y") == 0, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(own.cast("int")))))
    m = ranking.screening_metrics(wide, ["target_id", "series"], "value", "ligand_id", "y").select("target_id", settled("roc_auc").alias("roc_auc"), settled("bedroc").alias("bedroc"))
    whole = F.count("roc_auc") == 3
    return m.groupBy("target_id").agg(F.count("roc_auc").alias("evaluable"), F.when(whole, F.min("bedroc")).alias("worst_bedroc"), F.round(F.when(whole, F.avg("bedroc")), 8).alias("mean_bedroc"), F.round(F.avg("roc_auc"), 8).alias("mean_auc"))


@query(
    """WITH c AS (SELECT target_id, receptor_id, ligand_id, y FROM top JOIN best3 USING (target_id, receptor_id)), n AS (SELECT target_id, count(*) FILTER (y = 1) AS actives FROM (SELECT DISTINCT target_id, ligand_id, y FROM lab) GROUP BY ALL), h AS (SELECT target_id, ligand_id, y, count(*) AS k FROM c GROUP BY ALL)
 SELECT target_id, actives, count(*) FILTER (y = 1) AS single_hits, count(*) FILTER (y = 1 AND k >= 2) AS double_hits, count(*) FILTER (y = 1 AND k >= 3) AS triple_hits, count(*) FILTER (y = 0) AS decoy_hits, round(count(*) FILTER (y = 1) * 1.0 / nullif(actives, 0), 9) AS coverage FROM h JOIN n USING (target_id) GROUP BY target_id, actives""",
    "top best3",
)
def subset_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per target: actives that one, two or all three of the chosen scorers have in their top tenth."""
    rows = stored_labelled(spark, d)
    top = ranking.top_rows(rows, PAIR, "median_score", "ligand_id", 0.1).join(_best3(spark, d), PAIR)
    hits = top.groupBy("target_id", "ligand_id", "y").agg(F.count("*").alias("k"))
    whole = rows.select("target_id", "ligand_id", "y").distinct().groupBy("target_id").agg(F.count_if(F.col("y") == 1).alias("actives"))
    at = lambda n: F.count_if((F.col("y") == 1) & (F.col("k") >= n))
    out = hits.groupBy("target_id").agg(at(1).alias("single_hits"), at(2).alias("double_hits"), at(3).alias("triple_hits"), F.count_if(F.col("y") == 0).alias("decoy_hits")).join(whole, "target_id")
    return out.select("target_id", "actives", "single_hits", "double_hits", "triple_hits", "decoy_hits", F.try_divide("single_hits", "actives").alias("coverage"))


@query(
    f"""WITH a AS (SELECT DISTINCT target_id, receptor_id, ligand_id FROM top WHERE y = 1), n AS (SELECT target_id, count(DISTINCT ligand_id) AS actives FROM lab WHERE y = 1 GROUP BY ALL), dr AS (SELECT target_id, draw, receptor_id FROM (SELECT *, row_number() OVER (PARTITION BY target_id, draw ORDER BY u, receptor_id) AS k FROM (SELECT target_id, receptor_id, draw, {_U.format("'subset|' || draw || '|' || receptor_id")} AS u FROM (SELECT DISTINCT target_id, receptor_id FROM lab) CROSS JOIN range(200) AS t(draw))) WHERE k <= 3),
 c AS (SELECT dr.target_id, draw, count(DISTINCT ligand_id) AS hits FROM dr LEFT JOIN a USING (target_id, receptor_id) GROUP BY ALL), s AS (SELECT target_id, count(DISTINCT ligand_id) AS hits FROM best3 LEFT JOIN a USING (target_id, receptor_id) GROUP BY ALL)
 SELECT target_id, actives, s.hits AS selected_hits, round(avg(c.hits), 9) AS mean_hits, max(c.hits) AS most_hits, round(count(*) FILTER (c.hits >= s.hits) * 1.0 / count(*), 9) AS share_at_least FROM c JOIN s USING (target_id) JOIN n USING (target_id) GROUP BY target_id, actives, s.hits""",
    "top best3",
)
def drawn_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per target: actives covered by the chosen subset against 200 drawn subsets of its size."""
    rows = stored_labelled(spark, d)
    hit = materialize(ranking.top_rows(rows, PAIR, "median_score", "ligand_id", 0.1).where("y = 1").select(*PAIR, "ligand_id"), "hits")
    drawn = utilities.drawn_subsets(rows, ["target_id"], "receptor_id", 3, 200, "subset")
    covered = drawn.join(hit, PAIR, "left").groupBy("target_id", "draw").agg(F.countDistinct("ligand_id").alias("hits"))
    own = _best3(spark, d).join(hit, PAIR, "left").groupBy("target_id").agg(F.countDistinct("ligand_id").alias("selected_hits"))
    actives = rows.where("y = 1").groupBy("target_id").agg(F.countDistinct("ligand_id").alias("actives"))
    both = covered.join(own, "target_id").join(actives, "target_id")
    return both.groupBy("target_id", "actives", "selected_hits").agg(F.avg("hits").alias("mean_hits"), F.max("hits").alias("most_hits"), (F.count_if(F.col("hits") >= F.col("selected_hits")) / F.count("*")).alias("share_at_least"))


@query(
    """WITH n AS (SELECT target_id, count(DISTINCT ligand_id) AS actives FROM lab WHERE y = 1 GROUP BY ALL), s AS (SELECT target_id, receptor_id, ligand_id FROM top WHERE y = 1) SELECT x.target_id, x.receptor_id AS a, z.receptor_id AS b, count(*) AS common, round(count(*) * 1.0 / any_value(actives), 9) AS overlap FROM s x JOIN s z ON x.target_id = z.target_id AND x.ligand_id = z.ligand_id AND x.receptor_id < z.receptor_id JOIN n ON n.target_id = x.target_id GROUP BY ALL""",
    "top",
)
def coverage_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Per pair of scorers: actives both have in their top tenth, as a share of all actives; pairs without a common one are 0 and not listed."""
    rows = stored_labelled(spark, d)
    hit = materialize(ranking.top_rows(rows, PAIR, "median_score", "ligand_id", 0.1).where("y = 1").select(*PAIR, "ligand_id"), "hits")
    actives = rows.where("y = 1").groupBy("target_id").agg(F.countDistinct("ligand_id").alias("actives"))
    both = hit.withColumnRenamed("receptor_id", "a").join(hit.withColumnRenamed("receptor_id", "b"), ["target_id", "ligand_id"]).where("a < b")
    return both.groupBy("target_id", "a", "b").agg(F.count("*").alias("common")).join(actives, "target_id").select("target_id", "a", "b", "common", (F.col("common") / F.col("actives")).alias("overlap"))


@query(
    """WITH f AS (SELECT unnest([0.01, 0.05, 0.1]) AS fraction, unnest([0.5, 0.3, 0.2]) AS weight), n AS (SELECT target_id, count(DISTINCT ligand_id) AS actives FROM lab WHERE y = 1 GROUP BY ALL), p AS (SELECT target_id, receptor_id, ligand_id, y, row_number() OVER (PARTITION BY target_id, receptor_id ORDER BY median_score, ligand_id) AS r, count(*) OVER (PARTITION BY target_id, receptor_id) AS n FROM lab),
 h AS (SELECT target_id, receptor_id, any_value(weight) AS weight, count(*) FILTER (y = 1 AND r <= greatest(1, ceil(n * CAST(fraction AS DOUBLE)))) AS hits FROM p CROSS JOIN f GROUP BY target_id, receptor_id, fraction) SELECT target_id, receptor_id, CAST(sum(hits) AS BIGINT) AS all_hits, round(sum(weight * hits) / any_value(actives), 9) AS weighted_coverage FROM h JOIN n USING (target_id) GROUP BY ALL""",
    "lab",
)
def coverage_by_depth(spark: SparkSession, d: str) -> DataFrame:
    """Per scorer: actives among the first 1, 5 and 10 %, and their weighted shares of all actives."""
    rows = stored_labelled(spark, d)
    depth = {0.01: 0.5, 0.05: 0.3, 0.1: 0.2}
    from scorelake.operators.prefix import running_totals

    placed = running_totals(rows, PAIR, ["median_score", "ligand_id"], {"before": None}, totals=True)
    hit = lambda f: F.count_if((F.col("y") == 1) & (F.col("before") < F.greatest(F.lit(1), F.ceil(F.col("before_all") * F.lit(f)))))
    hits = placed.groupBy(*PAIR).agg(*(hit(f).alias(f"h{i}") for i, f in enumerate(depth)))
    actives = rows.where("y = 1").groupBy("target_id").agg(F.countDistinct("ligand_id").alias("actives"))
    total = sum((w * F.col(f"h{i}") for i, w in enumerate(depth.values())), F.lit(0.0))
    return hits.join(actives, "target_id").select(*PAIR, (F.col("h0") + F.col("h1") + F.col("h2")).alias("all_hits"), (total / F.col("actives")).alias("weighted_coverage"))


# Rank utilities


@query("SELECT * FROM utility", "utility")
def rank_utility(spark: SparkSession, d: str) -> DataFrame:
    return _utility(_ranks(spark, d))


_PAIRTERMS = """pt AS (SELECT target_id, a, b, CAST(sum(n) AS BIGINT) AS common, round((avg(u) + min(u)) / 2, 9) AS utility, greatest(0.0, coalesce(min(c), 0.0)) AS redundancy FROM (SELECT x.target_id, x.seed_id, x.receptor_id AS a, z.receptor_id AS b, count(*) AS n, avg(exp(-20.0 * least(x.r, z.r))) FILTER (x.y = 1) - avg(exp(-20.0 * least(x.r, z.r))) FILTER (x.y = 0) AS u,
 CASE WHEN var_pop(x.r) * count(*) > 1e-18 AND var_pop(z.r) * count(*) > 1e-18 THEN covar_pop(x.r, z.r) / sqrt(var_pop(x.r) * var_pop(z.r)) END AS c FROM ranks x JOIN ranks z ON x.target_id = z.target_id AND x.seed_id = z.seed_id AND x.ligand_id = z.ligand_id AND x.receptor_id < z.receptor_id GROUP BY ALL) GROUP BY ALL)"""


@query(f"WITH {_PAIRTERMS} SELECT pt.target_id, a, b, common, pt.utility, round(pt.utility - greatest(p.utility, q.utility), 9) AS gain, round(redundancy, 5) AS redundancy FROM pt LEFT JOIN utility p ON p.target_id = pt.target_id AND p.receptor_id = a LEFT JOIN utility q ON q.target_id = pt.target_id AND q.receptor_id = b", "utility")
def pair_rank_terms(spark: SparkSession, d: str) -> DataFrame:
    """Per pair of scorers: utility of the better rank, its gain over the better scorer alone, and stable redundancy."""
    ranks = materialize(_ranks(spark, d), "ranks")
    single = materialize(_utility(ranks).select(*PAIR, "utility"), "utility")
    pairs = utilities.pair_rank_terms(ranks, ["target_id"], "receptor_id", "seed_id", "ligand_id").withColumn("utility", settled("utility"))
    one = lambda t: single.select("target_id", F.col("receptor_id").alias(t), F.col("utility").alias(f"u_{t}"))
    both = pairs.join(one("a"), ["target_id", "a"], "left").join(one("b"), ["target_id", "b"], "left")
    return both.select("target_id", "a", "b", "common", "utility", (F.col("utility") - F.greatest("u_a", "u_b")).alias("gain"), F.round("redundancy", 5).alias("redundancy"))


_Z = "z AS (SELECT target_id, receptor_id, round(coalesce((utility - avg(utility) OVER w) / nullif(stddev_pop(utility) OVER w, 0), 0), 9) AS z FROM utility WINDOW w AS (PARTITION BY target_id))"


@query(
    f"""WITH {_PAIRTERMS}, {_Z}, g AS (SELECT pt.target_id, a, b, round(coalesce(pt.utility - greatest(p.utility, q.utility), 0), 9) AS gain FROM pt LEFT JOIN utility p ON p.target_id = pt.target_id AND p.receptor_id = a LEFT JOIN utility q ON q.target_id = pt.target_id AND q.receptor_id = b),
 s AS (SELECT p.target_id, p.receptor_id || '+' || q.receptor_id || '+' || t.receptor_id AS subset, round((p.z + q.z + t.z) / 3 + 0.5 * (coalesce(x.gain, 0) + coalesce(w.gain, 0) + coalesce(v.gain, 0)), 8) AS value FROM z p JOIN z q ON p.target_id = q.target_id AND p.receptor_id < q.receptor_id JOIN z t ON t.target_id = q.target_id AND q.receptor_id < t.receptor_id
 LEFT JOIN g x ON x.target_id = p.target_id AND x.a = p.receptor_id AND x.b = q.receptor_id LEFT JOIN g w ON w.target_id = p.target_id AND w.a = p.receptor_id AND w.b = t.receptor_id LEFT JOIN g v ON v.target_id = p.target_id AND v.a = q.receptor_id AND v.b = t.receptor_id)
 SELECT target_id, max(value) AS value, count(*) AS states FROM s GROUP BY ALL""",
    "utility",
)
def complementary_subset(spark: SparkSession, d: str) -> DataFrame:
    """Per target: the value of the best of all subsets of three, by mean standardized utility and the gains of their pairs."""
    from pyspark.sql import Window

    ranks = materialize(_ranks(spark, d), "ranks")
    single = materialize(_utility(ranks), "utility")
    of = Window.partitionBy("target_id")  # one row per scorer
    z = F.coalesce(F.try_divide(F.col("utility") - F.avg("utility").over(of), F.stddev_pop("utility").over(of)), F.lit(0.0))
    linear = materialize(single.select(*PAIR, settled(z).alias("z"), "utility"), "linear")
    pairs = utilities.pair_rank_terms(ranks, ["target_id"], "receptor_id", "seed_id", "ligand_id").withColumn("utility", settled("utility"))
    one = lambda t: single.select("target_id", F.col("receptor_id").alias(t), F.col("utility").alias(f"u_{t}"))
    gains = pairs.join(one("a"), ["target_id", "a"], "left").join(one("b"), ["target_id", "b"], "left").select("target_id", "a", "b", settled(F.coalesce(F.col("utility") - F.greatest("u_a", "u_b"), F.lit(0.0))).alias("agreement"))
    picked = subsets.enumerate_subsets(linear, ["target_id"], "receptor_id", 3)
    energy = subsets.subset_energy(picked, linear.select(*PAIR, (F.col("z") / 3).alias("gap")), materialize(gains, "gains"), ["target_id"], "receptor_id", 3, -0.5)
    return energy.groupBy("target_id").agg(F.max(F.round(-F.col("energy"), 8)).alias("value"), F.count("*").alias("states"))


_DEFICIT = "df AS (SELECT target_id, receptor_id, CAST(coalesce(ceil(round(20 * (max(utility) OVER w - utility) / nullif(max(utility) OVER w - min(utility) OVER w, 0), 6)), 0) AS BIGINT) AS deficit FROM utility WINDOW w AS (PARTITION BY target_id))"


@query(f"WITH {_DEFICIT} SELECT a.target_id, a.deficit + b.deficit + c.deficit AS deficit, count(*) AS subsets FROM df a JOIN df b ON a.target_id = b.target_id AND a.receptor_id < b.receptor_id JOIN df c ON c.target_id = b.target_id AND b.receptor_id < c.receptor_id GROUP BY ALL", "utility")
def deficit_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Per target: how many subsets of three have which sum of whole-number deficits of utility (20 is the range of a target)."""
    from pyspark.sql import Window

    of = Window.partitionBy("target_id")  # one row per scorer
    span = F.max("utility").over(of) - F.min("utility").over(of)
    each = _utility(_ranks(spark, d)).select(*PAIR, F.coalesce(F.ceil(F.round(F.try_divide(20 * (F.max("utility").over(of) - F.col("utility")), span), 6)), F.lit(0)).alias("deficit"))
    each = materialize(each, "deficits")
    out = subsets.enumerate_subsets(each, ["target_id"], "receptor_id", 3)
    for i in (1, 2, 3):
        out = out.join(each.select("target_id", F.col("receptor_id").alias(f"m{i}"), F.col("deficit").alias(f"d{i}")), ["target_id", f"m{i}"])
    return out.groupBy("target_id", (F.col("d1") + F.col("d2") + F.col("d3")).alias("deficit")).agg(F.count("*").alias("subsets"))


@query("SELECT target_id, receptor_id, level, round(round_even(utility / level, 0) * level, 9) AS quantized, round(abs(round_even(utility / level, 0) * level - utility), 9) AS moved FROM utility CROSS JOIN (SELECT unnest([CAST(0.01 AS DOUBLE), 0.05, 0.1]) AS level)", "utility")
def quantized_coefficients(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients rounded to grids of three widths, and how far that moves them."""
    rows = _utility(_ranks(spark, d)).withColumn("level", F.explode(F.array(F.lit(0.01), F.lit(0.05), F.lit(0.1))))
    grid = F.rint(F.col("utility") / F.col("level")) * F.col("level")
    return rows.select(*PAIR, "level", grid.alias("quantized"), F.abs(grid - F.col("utility")).alias("moved"))


@query(
    """WITH b AS (SELECT target_id, seed_id, receptor_id FROM (SELECT *, row_number() OVER (PARTITION BY target_id, seed_id ORDER BY roc_auc DESC NULLS LAST, receptor_id) AS k FROM seedmetrics) WHERE k <= 3), s AS (SELECT target_id, seed_id, list_sort(list(receptor_id)) AS m FROM b GROUP BY ALL),
 j AS (SELECT x.target_id, len(list_intersect(x.m, z.m)) * 1.0 / len(list_distinct(list_concat(x.m, z.m))) AS v FROM s x JOIN s z ON x.target_id = z.target_id AND x.seed_id < z.seed_id), a AS (SELECT target_id, count(*) AS selections, count(DISTINCT m) AS different, string_agg(array_to_string(m, '+'), ';' ORDER BY seed_id) AS subsets FROM s GROUP BY ALL)
 SELECT a.target_id, selections, different, subsets, round(avg(v), 9) AS mean_jaccard FROM a LEFT JOIN j ON j.target_id = a.target_id GROUP BY ALL""",
    "seedmetrics",
)
def selection_stability(spark: SparkSession, d: str) -> DataFrame:
    """Per target: the three best scorers of each replicate, how many such subsets differ, and their mean pairwise Jaccard."""
    rows = screening_metrics_by_replicate(spark, d).withColumn("roc_auc", settled("roc_auc"))
    best = ranking.best_groups(rows, ["target_id", "seed_id"], [F.desc_nulls_last("roc_auc"), F.asc("receptor_id")], 3).select("target_id", "seed_id", "receptor_id")
    lists = materialize(best.groupBy("target_id", "seed_id").agg(F.sort_array(F.collect_list("receptor_id")).alias("m")), "selected")
    other = lists.select("target_id", F.col("seed_id").alias("other"), F.col("m").alias("n"))
    pairs = lists.join(other, "target_id").where("seed_id < other").groupBy("target_id").agg(F.avg(F.size(F.array_intersect("m", "n")) / F.size(F.array_union("m", "n"))).alias("mean_jaccard"))
    told = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seed_id", "m"))), lambda x: F.array_join(x["m"], "+")), ";")
    out = lists.groupBy("target_id").agg(F.count("*").alias("selections"), F.countDistinct("m").alias("different"), told.alias("subsets"))
    return out.join(pairs, "target_id", "left").select("target_id", "selections", "different", "subsets", "mean_jaccard")


# Profiles over sizes


@query("WITH p AS (SELECT target_id, fold, k, round(value, 9) AS value FROM profile), b AS (SELECT target_id, fold, max(value) AS best, arg_max(k, (value, -k)) AS k FROM p GROUP BY ALL) SELECT p.target_id, p.k, count(*) AS folds, round(avg(value), 9) AS mean_value, round(max(best - value), 9) AS largest_gap, count(*) FILTER (best - value > 0.02) AS far_folds, count(*) FILTER (b.k = p.k) AS wins FROM p JOIN b USING (target_id, fold) GROUP BY ALL", "profile")
def size_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per target and size: mean over the replicates, largest gap to the replicate's best, replicates beyond the tolerance, and where it is best."""
    rows = materialize(size_profile(spark, d).withColumn("value", settled("value")), "profile")
    best = rows.groupBy("target_id", "fold").agg(F.max("value").alias("best"), F.max(F.struct("value", (-F.col("k")).alias("k")))["k"].alias("less"))
    gap = F.col("best") - F.col("value")
    return rows.join(best, ["target_id", "fold"]).groupBy("target_id", "k").agg(F.count("*").alias("folds"), F.avg("value").alias("mean_value"), F.max(gap).alias("largest_gap"), F.count_if(gap > 0.02).alias("far_folds"), F.count_if(-F.col("less") == F.col("k")).alias("wins"))


@query("WITH p AS (SELECT target_id, fold, k, round(value, 9) AS value FROM profile) SELECT target_id, fold, arg_max(k, (value, -k)) AS best_k, max(value) AS best_value, count(*) AS sizes, round(max(value) FILTER (k = 2) - max(value) FILTER (k = 1), 8) AS second_gain FROM p GROUP BY ALL", "profile")
def fold_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Per target and replicate: the best size (the smallest at ties) and what the second scorer adds."""
    rows = size_profile(spark, d).withColumn("value", settled("value"))
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    return rows.groupBy("target_id", "fold").agg((-F.max(F.struct("value", (-F.col("k")).alias("k")))["k"]).alias("best_k"), F.max("value").alias("best_value"), F.count("*").alias("sizes"), F.round(at(2) - at(1), 8).alias("second_gain"))


@query(
    """WITH e AS (SELECT target_id, k, round(k * avg(round(value, 9)), 9) AS benefit FROM profile GROUP BY target_id, k), s AS (SELECT x.target_id, x.k, max(CASE WHEN z.k > x.k THEN (x.benefit - z.benefit) / (x.k - z.k) END) AS lo, min(CASE WHEN z.k < x.k THEN (x.benefit - z.benefit) / (x.k - z.k) END) AS hi FROM e x LEFT JOIN e z ON z.target_id = x.target_id AND z.k <> x.k GROUP BY ALL)
 SELECT target_id, k, round(lo, 9) AS from_cost, round(hi, 9) AS to_cost, coalesce(round(lo, 9) <= round(hi, 9), true) AS supported FROM s""",
    "profile",
)
def supported_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Per target and size: the costs per scorer at which that size is the best trade."""
    rows = size_profile(spark, d).withColumn("value", settled("value"))
    benefit = materialize(rows.groupBy("target_id", "k").agg(settled(F.col("k") * F.avg("value")).alias("benefit")), "benefit")
    out = utilities.supported_intervals(benefit, ["target_id"], "k", "benefit").withColumns({c: settled(c) for c in ("from_cost", "to_cost")})
    return out.withColumn("supported", F.coalesce(F.col("from_cost") <= F.col("to_cost"), F.lit(True)))


# Bootstrap draws of metrics

_REPLICATES = 100
_DRAWS = f"""x AS (SELECT c.*, {_W} AS w FROM (SELECT s.*, replicate, {_U.format("'metric|' || replicate || '|' || unit")} AS u FROM s CROSS JOIN range({_REPLICATES}) AS t(replicate)) c), v AS (SELECT * FROM x WHERE w > 0),
 o AS (SELECT *, coalesce(sum(w) OVER f, 0) AS n0, coalesce(sum(w * y) OVER f, 0) AS a0, sum(w) OVER g AS n, sum(w * y) OVER g AS p, coalesce(sum(w * (1 - y)) OVER b, 0) AS d0, sum(w * (1 - y)) OVER e AS dt FROM v WINDOW f AS (PARTITION BY target_id, method, replicate ORDER BY value, ligand_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), g AS (PARTITION BY target_id, method, replicate), b AS (PARTITION BY target_id, method, replicate ORDER BY value RANGE UNBOUNDED PRECEDING), e AS (PARTITION BY target_id, method, replicate, value)),
 i AS (SELECT target_id, method, replicate, max(n) AS n, max(p) AS p, sum(CASE WHEN y = 1 THEN w * ((n - p) - d0 + dt / 2.0) END) AS won, sum(CASE WHEN y = 1 THEN list_sum([(a0 + j) / (n0 + j) for j in range(1, w + 1)]) END) AS ap, coalesce(sum(CASE WHEN y = 1 THEN list_sum([exp(-20.0 * (n0 + j) / n) for j in range(1, w + 1)]) END), 0) AS e FROM o GROUP BY ALL),
 q AS (SELECT *, exp(-20.0 / n) AS q FROM i), m AS (SELECT target_id, method, replicate, CASE WHEN p > 0 AND p < n THEN won / (p * (n - p)) END AS roc_auc, ap / nullif(p, 0) AS average_precision, CASE WHEN p > 0 AND p < n THEN (e - q * (1 - q ** p) / (1 - q) * q ** (n - p)) / (q * (1 - q ** p) / (1 - q) * (1 - q ** (n - p))) END AS bedroc FROM q)"""
_VALUES = ["roc_auc", "average_precision", "bedroc"]
_INTERVALS = ", ".join(f"round(avg({v}), 8) AS {v}_mean, round(quantile_cont({v}, 0.025), 8) AS {v}_low, round(quantile_cont({v}, 0.975), 8) AS {v}_high" for v in _VALUES)


def _draws(spark: SparkSession, d: str, blocks: bool) -> DataFrame:
    values = _consensus(stored_labelled(spark, d), ["target_id", "ligand_id", "y"])
    unit = "ligand_id"
    if blocks:
        values = values.join(labels(spark, d).select("ligand_id", F.coalesce("split_group_id", "ligand_id").alias("unit")), "ligand_id")
        unit = "unit"
    return utilities.bootstrap_metrics(values, ["target_id", "method"], unit, "ligand_id", "value", "y", _REPLICATES, "metric")


@query(f"WITH s AS (SELECT *, ligand_id AS unit FROM ({_CONSENSUS})), {_DRAWS} SELECT target_id, method, count(roc_auc) AS valid, {_INTERVALS} FROM m GROUP BY ALL", "lab")
def bootstrap_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Per target and method: mean and 95 % interval of ROC-AUC, average precision and BEDROC over bootstrap draws of entities."""
    out = utilities.intervals(_draws(spark, d, False), ["target_id", "method"], _VALUES)
    return out.select("target_id", "method", "valid", *(F.round(c, 8).alias(c) for c in out.columns[3:]))


@query(f"WITH s AS (SELECT c.*, coalesce(l.split_group_id, c.ligand_id) AS unit FROM ({_CONSENSUS}) c JOIN labels l USING (ligand_id)), {_DRAWS} SELECT target_id, method, count(roc_auc) AS valid, {_INTERVALS} FROM m GROUP BY ALL", "lab")
def block_bootstrap_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The same over draws of whole groups of related entities."""
    out = utilities.intervals(_draws(spark, d, True), ["target_id", "method"], _VALUES)
    return out.select("target_id", "method", "valid", *(F.round(c, 8).alias(c) for c in out.columns[3:]))


@query(
    f"""WITH s AS (SELECT c.*, coalesce(l.split_group_id, c.ligand_id) AS unit FROM ({_CONSENSUS}) c JOIN labels l USING (ligand_id)), {_DRAWS}, dl AS (SELECT target_id, replicate, {", ".join(f"max({v}) FILTER (method = 'least') - max({v}) FILTER (method = 'mean') AS {v}" for v in _VALUES)} FROM m GROUP BY ALL)
 SELECT target_id, count(roc_auc) AS valid, {_INTERVALS}, round(count(*) FILTER (bedroc > 1e-9) * 1.0 / nullif(count(bedroc), 0), 9) AS bedroc_support FROM dl GROUP BY ALL""",
    "lab",
)
def bootstrap_delta(spark: SparkSession, d: str) -> DataFrame:
    """Per target: paired difference of the two consensus methods over the same draws of groups."""
    draws = _draws(spark, d, True)
    side = lambda v, m: F.max(F.when(F.col("method") == m, F.col(v)))
    delta = draws.groupBy("target_id", "replicate").agg(*((side(v, "least") - side(v, "mean")).alias(v) for v in _VALUES))
    delta = materialize(delta, "delta")
    out = utilities.intervals(delta, ["target_id"], _VALUES)
    support = delta.groupBy("target_id").agg(F.try_divide(F.count_if(F.col("bedroc") > 1e-9), F.count("bedroc")).alias("bedroc_support"))
    return out.join(support, "target_id").select("target_id", "valid", *(F.round(c, 8).alias(c) for c in out.columns[2:]), "bedroc_support")


# Matrices and validation


@query("SELECT * FROM (PIVOT lab ON receptor_id USING min(median_score) GROUP BY target_id, ligand_id)", "lab")
def scorer_matrix(spark: SparkSession, d: str) -> DataFrame:
    """One row per target and entity, one column per scorer of the data (an error beyond 2,000), missing cells null."""
    from scorelake.operators import scores

    rows = stored_labelled(spark, d)
    found = sorted(r[0] for r in rows.select("receptor_id").distinct().limit(2001).collect())
    if len(found) > 2000:
        raise ValueError("more than 2000 scorers for the columns of a matrix")
    return scores.score_matrix(rows, ["target_id", "ligand_id"], "receptor_id", found, "median_score")


@query(
    """WITH g AS (SELECT target_id, ligand_id, receptor_id FROM (SELECT DISTINCT target_id, ligand_id FROM lab) JOIN (SELECT DISTINCT target_id, receptor_id FROM lab) USING (target_id)) SELECT target_id, receptor_id, count(*) AS cells, count(*) FILTER (l.ligand_id IS NULL) AS missing_cells FROM g LEFT JOIN lab l USING (target_id, ligand_id, receptor_id) GROUP BY ALL""",
    "lab",
)
def missing_cells(spark: SparkSession, d: str) -> DataFrame:
    """Per scorer: the cells its column of the matrix should have and those that are missing, from counts; the grid is never built."""
    rows = stored_labelled(spark, d)
    entities = rows.groupBy("target_id").agg(F.countDistinct("ligand_id").alias("cells"))
    return rows.groupBy(*PAIR).agg(F.countDistinct("ligand_id").alias("have")).join(entities, "target_id").select(*PAIR, "cells", (F.col("cells") - F.col("have")).alias("missing_cells"))


@query(
    """WITH k AS (SELECT ligand_id, count(DISTINCT CASE WHEN lower(trim(label)) IN ('active', '1') THEN 1 WHEN lower(trim(label)) IN ('decoy', 'inactive', '0') THEN 0 END) AS labels, count(DISTINCT target_id) AS targets, count(*) AS n, count(outer_fold) AS folds FROM ligands GROUP BY ALL), s AS (SELECT DISTINCT ligand_id FROM seed_scores), r AS (SELECT DISTINCT receptor_id FROM seed_scores)
 SELECT name, count, count = 0 AS passed FROM (SELECT 'repeated_ids' AS name, count(*) FILTER (n > 1) AS count FROM k UNION ALL SELECT 'contradicting_labels', count(*) FILTER (labels > 1) FROM k UNION ALL SELECT 'no_label', count(*) FILTER (labels = 0) FROM k UNION ALL SELECT 'several_targets', count(*) FILTER (targets > 1) FROM k UNION ALL SELECT 'no_fold', count(*) FILTER (folds = 0) FROM k
 UNION ALL SELECT 'scored_not_listed', count(*) FROM s ANTI JOIN k USING (ligand_id) UNION ALL SELECT 'listed_not_scored', count(*) FROM k ANTI JOIN s USING (ligand_id) UNION ALL SELECT 'unknown_scorers', count(*) FROM r WHERE receptor_id NOT IN (SELECT conformer_id FROM receptors WHERE conformer_id IS NOT NULL))"""
)
def dataset_validation(spark: SparkSession, d: str) -> DataFrame:
    """One row per check of the manifest against itself and the scores: what breaks it, and whether it passes."""
    ligands, scores = table(spark, d, "ligands"), table(spark, d, "seed_scores")
    text = F.lower(F.trim("label"))
    y = F.when(text.isin("active", "1"), 1).when(text.isin("decoy", "inactive", "0"), 0)
    known = materialize(ligands.groupBy("ligand_id").agg(F.countDistinct(y).alias("labels"), F.countDistinct("target_id").alias("targets"), F.count("*").alias("n"), F.count("outer_fold").alias("folds")), "known")
    scored = scores.select("ligand_id").distinct()
    own = known.agg(F.count_if(F.col("n") > 1).alias("repeated_ids"), F.count_if(F.col("labels") > 1).alias("contradicting_labels"), F.count_if(F.col("labels") == 0).alias("no_label"), F.count_if(F.col("targets") > 1).alias("several_targets"), F.count_if(F.col("folds") == 0).alias("no_fold"))
    out = own.unpivot([], own.columns, "name", "count")
    receptors = table(spark, d, "receptors").select(F.col("conformer_id").alias("receptor_id"))
    for name, left, right, key in (("scored_not_listed", scored, known, "ligand_id"), ("listed_not_scored", known, scored, "ligand_id"), ("unknown_scorers", scores.select("receptor_id").distinct(), receptors, "receptor_id")):
        out = out.unionAll(left.join(right, key, "left_anti").agg(F.count("*").alias("count")).select(F.lit(name).alias("name"), "count"))
    return out.withColumn("passed", F.col("count") == 0)


@query(
    """WITH s AS (SELECT target_id, receptor_id, split_group_id, median(median_score) AS m FROM lab WHERE split_group_id IS NOT NULL GROUP BY ALL) SELECT target_id, receptor_id, count(*) AS groups, round(avg(m), 9) AS mean_group, round(median(m), 9) AS median_group, count(*) >= 5 AND avg(m) < -6 AS passed FROM s GROUP BY ALL""",
    "lab",
)
def group_medians(spark: SparkSession, d: str) -> DataFrame:
    """Per scorer over the medians of groups of related entities: their number, mean and median, and whether both gates are passed."""
    from scorelake.plans.base import labelled

    each = labelled(spark, d).where("split_group_id IS NOT NULL").groupBy(*PAIR, "split_group_id").agg(F.median("median_score").alias("m"))
    return each.groupBy(*PAIR).agg(F.count("*").alias("groups"), F.avg("m").alias("mean_group"), F.median("m").alias("median_group"), ((F.count("*") >= 5) & (F.avg("m") < -6)).alias("passed"))


@query("SELECT target_id, receptor_id, string_agg(ligand_id, ';' ORDER BY position) AS first_ids, count(*) FILTER (y = 1) AS actives FROM (SELECT *, row_number() OVER (PARTITION BY target_id, receptor_id ORDER BY median_score, ligand_id) AS position FROM lab) WHERE position <= 10 GROUP BY ALL", "lab")
def first_ids(spark: SparkSession, d: str) -> DataFrame:
    """Per scorer: its ten best entities in order, and the actives among them."""
    from scorelake.operators.prefix import row_numbers

    placed = row_numbers(stored_labelled(spark, d), PAIR, ["median_score", "ligand_id"], "position").where("position <= 10")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "ligand_id"))), lambda x: x["ligand_id"]), ";")
    return placed.groupBy(*PAIR).agg(ids.alias("first_ids"), F.count_if(F.col("y") == 1).alias("actives"))


@query("SELECT pool_id, a, b, distance, round(distance / nullif(max(distance) OVER (PARTITION BY pool_id), 0), 9) AS scaled FROM pairs JOIN members ON id = a", "pairs members")
def scaled_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distances as shares of the pool's greatest."""
    from scorelake.operators import geometry
    from scorelake.plans.base import members

    pairs = geometry.clean_pairs(table(spark, d, "conformer_distances"), "conformer_id_a", "conformer_id_b", "standardized_pocket_distance")
    own = pairs.join(members(spark, d).select(F.col("id").alias("a"), "pool_id"), "a")
    most = own.groupBy("pool_id").agg(F.max("distance").alias("most"))
    return own.join(most, "pool_id").select("pool_id", "a", "b", "distance", F.try_divide("distance", "most").alias("scaled"))


@query(
    """WITH c AS (SELECT conformer_id, max(pocket_features) AS f FROM conformers WHERE pocket_features IS NOT NULL GROUP BY ALL), p AS (SELECT conformer_id, i, f[3 * i + 1] AS x, f[3 * i + 2] AS v, f[3 * i + 3] AS z FROM (SELECT conformer_id, f, unnest(range(len(f) // 3)) AS i FROM c))
 SELECT a.conformer_id, CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.v - b.v) * (a.v - b.v) + (a.z - b.z) * (a.z - b.z)), 8) AS distance FROM p a JOIN p b ON a.conformer_id = b.conformer_id AND a.i < b.i"""
)
def point_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distances between the points (triples of features) of each structure."""
    rows = table(spark, d, "conformers").where("pocket_features IS NOT NULL").groupBy("conformer_id").agg(F.max("pocket_features").alias("f"))
    points = F.transform(F.sequence(F.lit(0), F.floor(F.size("f") / 3).cast("int") - 1), lambda i: F.slice("f", 3 * i + 1, 3))
    each = rows.where("size(f) >= 3").select("conformer_id", points.alias("points")).select("conformer_id", "points", F.posexplode("points").alias("i", "p")).select("conformer_id", "i", "p", F.posexplode("points").alias("j", "q")).where("i < j")
    square = F.aggregate(F.zip_with("p", "q", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return each.select("conformer_id", "i", "j", F.round(F.sqrt(square), 8).alias("distance"))
