"""Queries that compare selections, replicates and baselines, and subsets of several sizes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions.numbers import settled
from scorelake.operators import geometry, series, subsets, utilities
from scorelake.plans.base import cells, labelled_cells, labels, members, query, stored_labelled
from scorelake.plans.derived_queries import _COEF, _coefficients
from scorelake.plans.score_queries import _SPLIT, best_receptors, screening_metrics_by_replicate, split_of
from scorelake.sources.tables import table
from scorelake.storage import materialize, scratch_folder
from scorelake.streaming import events

PAIR = ["target_id", "receptor_id"]


@query("SELECT * FROM (PIVOT (SELECT pool_id, source_type, resolution_angstrom FROM conformers WHERE source_type IS NOT NULL) ON source_type USING min(resolution_angstrom) AS least, max(resolution_angstrom) AS most GROUP BY pool_id)")
def pool_matrix(spark: SparkSession, d: str) -> DataFrame:
    """One row per pool, two columns per source type of the data (an error beyond 1,000): its least and greatest resolution."""
    rows = table(spark, d, "conformers").where("source_type IS NOT NULL")
    kinds = sorted(r[0] for r in rows.select("source_type").distinct().limit(1001).collect())
    if len(kinds) > 1000:
        raise ValueError("more than 1000 source types for the columns of a matrix")
    return rows.groupBy("pool_id").pivot("source_type", kinds).agg(F.min("resolution_angstrom").alias("least"), F.max("resolution_angstrom").alias("most"))


@query(
    """WITH s AS (SELECT target_id, ligand_id, receptor_id, min(score) FILTER (seed_id = 's11') AS x, min(score) FILTER (seed_id = 's23') AS v FROM cells WHERE seed_id IN ('s11', 's23') GROUP BY ALL) SELECT target_id, count(*) AS keys, count(*) FILTER (x IS NOT NULL AND v IS NOT NULL) AS merged, count(*) FILTER (v IS NULL) AS only_first, count(*) FILTER (x IS NULL) AS only_second, count(*) FILTER (x IS NOT NULL AND v IS NOT NULL) = count(*) AS one_to_one FROM s GROUP BY ALL""",
    "cells",
)
def matrix_merge(spark: SparkSession, d: str) -> DataFrame:
    """Per target: how two replicates' matrices fit together cell by cell."""
    rows = cells(spark, d)
    key = ["target_id", "ligand_id", "receptor_id"]
    side = lambda seed, n: rows.where(F.col("seed_id") == seed).groupBy(*key).agg(F.min("score").alias(n))
    both = side("s11", "x").join(side("s23", "v"), key, "full_outer")
    merged = F.col("x").isNotNull() & F.col("v").isNotNull()
    return both.groupBy("target_id").agg(F.count("*").alias("keys"), F.count_if(merged).alias("merged"), F.count_if(F.col("v").isNull()).alias("only_first"), F.count_if(F.col("x").isNull()).alias("only_second"), (F.count_if(merged) == F.count("*")).alias("one_to_one"))


@query(
    """WITH b AS (SELECT target_id, receptor_id, row_number() OVER (PARTITION BY target_id ORDER BY roc_auc DESC NULLS LAST, average_precision DESC NULLS LAST, receptor_id) AS k FROM metrics), e AS (SELECT r.target_id, r.ligand_id, r.y, r.seed_id, min(r.r) AS many, min(r.r) FILTER (k = 1) AS one FROM ranks r JOIN b USING (target_id, receptor_id) WHERE k <= 3 GROUP BY ALL),
 m AS (SELECT target_id, ligand_id, y, median(many) <= CAST(0.1 AS DOUBLE) AS in_many, coalesce(median(one) <= CAST(0.1 AS DOUBLE), false) AS in_one FROM e GROUP BY ALL) SELECT target_id, y, count(*) FILTER (in_one AND in_many) AS kept, count(*) FILTER (in_many AND NOT in_one) AS gained, count(*) FILTER (in_one AND NOT in_many) AS lost, count(*) FILTER (NOT in_one AND NOT in_many) AS neither FROM m GROUP BY ALL""",
    "metrics ranks",
)
def gained_and_lost(spark: SparkSession, d: str) -> DataFrame:
    """Per target and class: entities whose median rank is in the first tenth with the best scorer alone, with the best three, with both or with neither."""
    best = materialize(best_receptors(spark, d).select(*PAIR, F.col("rank").alias("k")), "best")
    rows = labelled_cells(spark, d).select(*PAIR, "seed_id", "ligand_id", "score", "y")
    ranks = utilities.rank_shares(rows, [*PAIR, "seed_id"], "score", "ligand_id").join(best, PAIR)
    each = ranks.groupBy("target_id", "ligand_id", "y", "seed_id").agg(F.min("r").alias("many"), F.min(F.when(F.col("k") == 1, F.col("r"))).alias("one"))
    middle = each.groupBy("target_id", "ligand_id", "y").agg((F.median("many") <= 0.1).alias("in_many"), F.coalesce(F.median("one") <= 0.1, F.lit(False)).alias("in_one"))
    a, b = F.col("in_one"), F.col("in_many")
    return middle.groupBy("target_id", "y").agg(F.count_if(a & b).alias("kept"), F.count_if(b & ~a).alias("gained"), F.count_if(a & ~b).alias("lost"), F.count_if(~a & ~b).alias("neither"))


@query(
    f"""WITH s AS (SELECT target_id, receptor_id, y, median_score, {_SPLIT} = 'train' AS fit FROM lab), g AS (SELECT target_id, receptor_id, avg(median_score) FILTER (fit AND y = 0) - avg(median_score) FILTER (fit AND y = 1) AS a, avg(median_score) FILTER (NOT fit AND y = 0) - avg(median_score) FILTER (NOT fit AND y = 1) AS b FROM s GROUP BY ALL)
 SELECT target_id, count(*) AS scorers, count(*) FILTER (a > 1e-9) AS positive, count(*) FILTER (a > 1e-9 AND b > 1e-9) AS kept_sign, round(count(*) FILTER (a > 1e-9 AND b > 1e-9) * 1.0 / nullif(count(*) FILTER (a > 1e-9), 0), 9) AS success, round(CASE WHEN count(*) > 1 AND var_pop(a) > 1e-18 AND var_pop(b) > 1e-18 THEN covar_pop(a, b) / sqrt(var_pop(a) * var_pop(b)) END, 5) AS correlation FROM g WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL""",
    "lab",
)
def sign_transfer(spark: SparkSession, d: str) -> DataFrame:
    """Per target: how often a scorer's class gap on the training entities keeps its sign on the others, and the correlation of both."""
    rows = stored_labelled(spark, d).withColumn("fit", split_of("ligand_id") == "train")
    mean = lambda fit, y: F.avg(F.when((F.col("fit") == fit) & (F.col("y") == y), F.col("median_score")))
    gaps = rows.groupBy(*PAIR).agg((mean(True, 0) - mean(True, 1)).alias("a"), (mean(False, 0) - mean(False, 1)).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    up, kept = F.count_if(F.col("a") > 1e-9), F.count_if((F.col("a") > 1e-9) & (F.col("b") > 1e-9))
    steady = (F.count("*") > 1) & (F.var_pop("a") > 1e-18) & (F.var_pop("b") > 1e-18)
    return gaps.groupBy("target_id").agg(F.count("*").alias("scorers"), up.alias("positive"), kept.alias("kept_sign"), F.try_divide(kept, up).alias("success"), F.round(F.when(steady, F.try_divide(F.covar_pop("a", "b"), F.sqrt(F.var_pop("a") * F.var_pop("b")))), 5).alias("correlation"))


@query(
    """WITH x AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events), r AS (SELECT user_id, event_type, g, count(*) AS n FROM x GROUP BY ALL), s AS (SELECT user_id, event_type, count(*) AS runs, max(n) AS longest, sum(n) AS occupancy FROM r GROUP BY ALL)
 SELECT event_type, CASE WHEN runs > 1 AND occupancy >= 5 THEN 'recurrent' WHEN runs > 1 THEN 'revisited' WHEN longest >= 3 THEN 'persistent' ELSE 'transient' END AS role, count(*) AS users FROM s GROUP BY ALL"""
)
def state_roles(spark: SparkSession, d: str) -> DataFrame:
    """Users by the role a state plays for them: recurrent, revisited, persistent or transient."""
    runs = series.state_runs(table(spark, d, "events"), "user_id", "ts", "event_id", "event_type")
    role = F.when((F.col("runs") > 1) & (F.col("occupancy") >= 5), "recurrent").when(F.col("runs") > 1, "revisited").when(F.col("longest_run") >= 3, "persistent").otherwise("transient")
    return runs.groupBy("event_type", role.alias("role")).agg(F.count("*").alias("users"))


@query("SELECT seed_id, count(*) AS row_count, count(DISTINCT ligand_id) AS entities, round(avg(score), 9) AS mean_value FROM cells WHERE seed_id = 's11' GROUP BY ALL", "cells")
def summary_row(spark: SparkSession, d: str) -> DataFrame:
    """The one summary row of a scope; none or several would be an error."""
    rows = series.scope_summary(cells(spark, d), "target_id", ["seed_id"], "score", "ligand_id").where("scope = 'ALL' AND seed_id = 's11'")
    return series.exactly_one(rows, ["seed_id"]).drop("scope")


@query(
    """WITH p AS (SELECT conformer_id, max(source_pool) AS source_pool FROM receptors GROUP BY ALL), j AS (SELECT c.*, coalesce(source_pool, 'none') AS source_pool FROM labcells c LEFT JOIN p ON conformer_id = receptor_id), o AS (SELECT *, row_number() OVER (PARTITION BY target_id, source_pool, y ORDER BY score, CASE seed_id WHEN 's11' THEN 0 WHEN 's23' THEN 1 ELSE 2 END, ligand_id, receptor_id, seed_id) AS k, count(*) OVER (PARTITION BY target_id, source_pool, y) AS n FROM j)
 SELECT target_id, source_pool, y, n AS cells, score AS least_score, ligand_id, receptor_id, seed_id FROM o WHERE k = 1""",
    "labcells",
)
def preferred_best(spark: SparkSession, d: str) -> DataFrame:
    """Per target, source pool and class: the best cell, at ties that of the preferred replicate."""
    pools = table(spark, d, "receptors").groupBy(F.col("conformer_id").alias("receptor_id")).agg(F.max("source_pool").alias("source_pool"))
    rows = labelled_cells(spark, d).join(pools, "receptor_id", "left").withColumn("source_pool", F.coalesce("source_pool", F.lit("none")))
    preference = F.when(F.col("seed_id") == "s11", 0).when(F.col("seed_id") == "s23", 1).otherwise(2)
    best = F.min(F.struct("score", preference.alias("p"), "ligand_id", "receptor_id", "seed_id")).alias("b")
    return rows.groupBy("target_id", "source_pool", "y").agg(F.count("*").alias("cells"), best).select("target_id", "source_pool", "y", "cells", F.col("b.score").alias("least_score"), "b.ligand_id", "b.receptor_id", "b.seed_id")


@query(
    """WITH m AS (SELECT target_id, receptor_id, seed_id, roc_auc FROM seedmetrics WHERE roc_auc IS NOT NULL), t AS (SELECT target_id, seed_id, max(roc_auc) AS best, median(roc_auc) AS middle FROM m GROUP BY ALL), f AS (SELECT target_id, receptor_id, roc_auc AS first FROM m WHERE seed_id = 's11')
 SELECT target_id, count(*) AS results, round(avg(best - roc_auc), 8) AS gap_to_best, round(avg(roc_auc - middle), 8) AS gain_over_middle, round(avg(roc_auc - first), 8) AS change_to_first, count(*) FILTER (roc_auc >= middle - 1e-9) AS not_below_middle FROM m JOIN t USING (target_id, seed_id) LEFT JOIN f USING (target_id, receptor_id) GROUP BY ALL""",
    "seedmetrics",
)
def baseline_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Per target: results against three baselines: the replicate's best scorer, its median, and the same scorer in the first replicate."""
    rows = materialize(screening_metrics_by_replicate(spark, d).where("roc_auc IS NOT NULL").select(*PAIR, "seed_id", settled("roc_auc").alias("roc_auc")), "results")
    whole = rows.groupBy("target_id", "seed_id").agg(F.max("roc_auc").alias("best"), F.median("roc_auc").alias("middle"))
    first = rows.where("seed_id = 's11'").select(*PAIR, F.col("roc_auc").alias("first"))
    v, mean = F.col("roc_auc"), lambda c, n: F.round(F.avg(c), 8).alias(n)
    both = rows.join(whole, ["target_id", "seed_id"]).join(first, PAIR, "left")
    return both.groupBy("target_id").agg(F.count("*").alias("results"), mean(F.col("best") - v, "gap_to_best"), mean(v - F.col("middle"), "gain_over_middle"), mean(v - F.col("first"), "change_to_first"), F.count_if(v >= F.col("middle") - 1e-9).alias("not_below_middle"))


_POOLED = "po AS (SELECT DISTINCT l.target_id, l.receptor_id, coalesce(r.source_pool, 'none') AS pool FROM lab l LEFT JOIN (SELECT conformer_id, max(source_pool) AS source_pool FROM receptors GROUP BY ALL) r ON r.conformer_id = l.receptor_id)"


@query(
    f"WITH {_POOLED}, s AS (SELECT a.target_id, len(list_distinct([a.pool, b.pool, c.pool])) AS pools FROM po a JOIN po b ON a.target_id = b.target_id AND a.receptor_id < b.receptor_id JOIN po c ON c.target_id = b.target_id AND b.receptor_id < c.receptor_id) SELECT target_id, count(*) AS subsets, count(*) FILTER (pools = 1) AS of_one_pool, count(*) FILTER (pools = 2) AS of_two_pools, count(*) FILTER (pools = 3) AS of_three_pools FROM s GROUP BY ALL",
    "lab",
)
def subset_support(spark: SparkSession, d: str) -> DataFrame:
    """Per target: from how many source pools the members of each subset of three come."""
    pools = table(spark, d, "receptors").groupBy(F.col("conformer_id").alias("receptor_id")).agg(F.max("source_pool").alias("pool"))
    rows = stored_labelled(spark, d).select(*PAIR).distinct().join(pools, "receptor_id", "left").select(*PAIR, F.coalesce("pool", F.lit("none")).alias("pool"))
    rows = materialize(rows, "pools")
    out = subsets.enumerate_subsets(rows, ["target_id"], "receptor_id", 3)
    for i in (1, 2, 3):
        out = out.join(rows.select("target_id", F.col("receptor_id").alias(f"m{i}"), F.col("pool").alias(f"p{i}")), ["target_id", f"m{i}"])
    n = F.size(F.array_distinct(F.array("p1", "p2", "p3")))
    return out.groupBy("target_id").agg(F.count("*").alias("subsets"), *(F.count_if(n == k).alias(f"of_{w}") for k, w in ((1, "one_pool"), (2, "two_pools"), (3, "three_pools"))))


@query(
    f"""WITH {_COEF}, e1 AS (SELECT target_id, 1 AS k, receptor_id AS subset, round(-gap, 9) AS energy FROM lin), e2 AS (SELECT p.target_id, 2 AS k, p.receptor_id || '+' || q.receptor_id AS subset, round(-p.gap - q.gap + 0.5 * coalesce(x.agreement, 0), 9) AS energy FROM lin p JOIN lin q ON p.target_id = q.target_id AND p.receptor_id < q.receptor_id LEFT JOIN quad x ON x.target_id = p.target_id AND x.a = p.receptor_id AND x.b = q.receptor_id),
 e3 AS (SELECT p.target_id, 3 AS k, p.receptor_id || '+' || q.receptor_id || '+' || s.receptor_id AS subset, round(-p.gap - q.gap - s.gap + 0.5 * (coalesce(x.agreement, 0) + coalesce(w.agreement, 0) + coalesce(z.agreement, 0)), 9) AS energy FROM lin p JOIN lin q ON p.target_id = q.target_id AND p.receptor_id < q.receptor_id JOIN lin s ON s.target_id = q.target_id AND q.receptor_id < s.receptor_id
 LEFT JOIN quad x ON x.target_id = p.target_id AND x.a = p.receptor_id AND x.b = q.receptor_id LEFT JOIN quad w ON w.target_id = p.target_id AND w.a = p.receptor_id AND w.b = s.receptor_id LEFT JOIN quad z ON z.target_id = p.target_id AND z.a = q.receptor_id AND z.b = s.receptor_id),
 e AS (SELECT * FROM e1 UNION ALL SELECT * FROM e2 UNION ALL SELECT * FROM e3), b AS (SELECT target_id, k, min(energy) AS least FROM e GROUP BY ALL) SELECT target_id, CAST(k AS INTEGER) AS k, least AS energy, min(subset) FILTER (energy = least) AS subset, count(*) AS states, count(*) FILTER (energy <= least + 1e-6) AS degeneracy FROM e JOIN b USING (target_id, k) GROUP BY ALL""",
    "lab",
)
def best_by_size(spark: SparkSession, d: str) -> DataFrame:
    """Per target and size from one to three: the subset of least energy, how many subsets there are, and how many share its energy."""
    linear, pairs = _coefficients(spark, d)
    every = None
    for k in (1, 2, 3):
        picked = subsets.enumerate_subsets(linear, ["target_id"], "receptor_id", k)
        own = subsets.subset_energy(picked, linear, pairs, ["target_id"], "receptor_id", k, 0.5).select("target_id", F.lit(k).alias("k"), "subset", settled("energy").alias("energy"))
        every = own if every is None else every.unionAll(own)
    every = materialize(every, "energies")
    best = every.groupBy("target_id", "k").agg(F.min("energy").alias("least"))
    e = F.col("energy")
    return every.join(best, ["target_id", "k"]).groupBy("target_id", "k", F.col("least").alias("energy_")).agg(F.min(F.when(e == F.col("least"), F.col("subset"))).alias("subset"), F.count("*").alias("states"), F.count_if(e <= F.col("least") + 1e-6).alias("degeneracy")).withColumnRenamed("energy_", "energy")


@query()
def maxsum_conformers(spark: SparkSession, d: str) -> DataFrame:
    """Per pool: conformers, each with the greatest sum of distances to those before, as many as the largest request asks for."""
    most = table(spark, d, "selection_requests").agg(F.max("subset_size")).first()[0] or 0
    pairs = geometry.clean_pairs(table(spark, d, "conformer_distances"), "conformer_id_a", "conformer_id_b", "standardized_pocket_distance")
    scoped = geometry.both_ways(pairs).join(members(spark, d).select(F.col("id").alias("a"), "pool_id"), "a")
    return subsets.maxmin_path(materialize(scoped, "distances"), ["pool_id"], most, total=True).where(F.col("step") <= most)


@query("WITH w AS (SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL) SELECT CAST(strftime(day, '%Y-%m-%d') AS VARCHAR) AS day, event_type, n, total FROM w WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def streamed_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events per closed day and type, written by a stream as soon as the watermark, a day behind, passes the day's end."""
    folder = f"{scratch_folder(spark).rstrip('/')}/scorelake/windows-{uuid.uuid4().hex}"
    stream = events.read_stream(spark, f"{d}/events.parquet", table(spark, d, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))
    counted = events.windowed_counts(stream, "ts", "event_type", "value", "1 day", "1 day")
    events.run_to_table(counted, folder, f"{folder}-checkpoint")
    rows = spark.read.schema(counted.schema).parquet(folder)
    return rows.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 6).alias("total"))


@query("SELECT selection_role, count(*) AS ligands, count(*) FILTER (l.y = 1) AS actives FROM (SELECT DISTINCT ligand_id, coalesce(selection_role, 'none') AS selection_role FROM ligands) r JOIN labels l USING (ligand_id) WHERE ligand_id NOT IN (SELECT ligand_id FROM ligands WHERE outer_fold = 0 AND ligand_id IS NOT NULL) AND ligand_id IN (SELECT ligand_id FROM seed_scores) GROUP BY ALL", "labels")
def panel_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Per role: labelled entities that are scored and in no locked fold, from which a panel may be drawn (semi and anti join)."""
    rows = table(spark, d, "ligands")
    locked = rows.where("outer_fold = 0 AND ligand_id IS NOT NULL").select("ligand_id")
    scored = table(spark, d, "seed_scores").select("ligand_id")
    roles = rows.select("ligand_id", F.coalesce("selection_role", F.lit("none")).alias("selection_role")).distinct()
    free = roles.join(labels(spark, d).select("ligand_id", "y"), "ligand_id").join(locked, "ligand_id", "left_anti").join(scored, "ligand_id", "left_semi")
    return free.groupBy("selection_role").agg(F.count("*").alias("ligands"), F.count_if(F.col("y") == 1).alias("actives"))

