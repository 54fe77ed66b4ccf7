"""Nested selections as one plan each, objectives over subsets, and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions.numbers import settled
from scorelake.operators import folds, geometry, ranking, subsets
from scorelake.operators.normalize import soft_threshold
from scorelake.operators.prefix import row_numbers
from scorelake.plans.base import _metrics_sql, labelled_cells, members, query, stored_labelled
from scorelake.plans.derived_queries import _EVERY
from scorelake.sources.tables import table
from scorelake.storage import materialize, scratch_folder
from scorelake.streaming import events

PAIR = ["target_id", "receptor_id"]
_FOLD = "f AS (SELECT target_id, ligand_id, CAST((row_number() OVER (PARTITION BY target_id, y ORDER BY sha256('fold|' || ligand_id), ligand_id) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT target_id, ligand_id, y FROM lab))"


def _folded(spark: SparkSession, d: str) -> DataFrame:
    rows = stored_labelled(spark, d).select(*PAIR, "ligand_id", "median_score", "y")
    return rows.join(folds.hash_folds(rows.select("target_id", "ligand_id", "y").distinct(), ["target_id", "y"], "ligand_id", 5, "fold").drop("y"), ["target_id", "ligand_id"])


@query(
    f"""WITH {_FOLD}, r AS (SELECT l.target_id, l.receptor_id, l.ligand_id, l.median_score, l.y, f.fold FROM lab l JOIN f USING (target_id, ligand_id)), tr AS (SELECT r.*, o.outer_fold FROM r JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS outer_fold) o ON fold <> outer_fold), mt AS ({_metrics_sql("tr", "target_id, outer_fold, receptor_id", "median_score")}),
 best AS (SELECT target_id, outer_fold, arg_max(receptor_id, (roc_auc, average_precision, receptor_id)) AS receptor_id, max(roc_auc) AS train_auc FROM mt WHERE roc_auc IS NOT NULL GROUP BY ALL), te AS (SELECT r.*, fold AS outer_fold FROM r), mh AS ({_metrics_sql("te", "target_id, outer_fold, receptor_id", "median_score")})
 SELECT best.target_id, CAST(best.outer_fold AS INTEGER) AS outer_fold, best.receptor_id, train_auc, mh.entity_count AS holdout_count, mh.roc_auc AS holdout_auc FROM best LEFT JOIN mh USING (target_id, outer_fold, receptor_id)""",
    "lab",
)
def nested_selection(spark: SparkSession, d: str) -> DataFrame:
    """Per target and outer fold: the receptor that is best on the other folds, judged on the one left out; all folds at once."""
    rows = _folded(spark, d)
    train = rows.withColumn("outer_fold", F.explode(F.array(*(F.lit(i) for i in range(5))))).where("fold <> outer_fold")
    key = ["target_id", "outer_fold", "receptor_id"]
    fitted = ranking.screening_metrics(train, key, "median_score", "ligand_id", "y").where("roc_auc IS NOT NULL").select(*key, settled("roc_auc").alias("roc_auc"), settled("average_precision").alias("ap"))
    best = fitted.groupBy("target_id", "outer_fold").agg(F.max(F.struct("roc_auc", "ap", "receptor_id")).alias("b")).select("target_id", "outer_fold", "b.receptor_id", F.col("b.roc_auc").alias("train_auc"))
    judged = ranking.screening_metrics(rows.withColumnRenamed("fold", "outer_fold"), key, "median_score", "ligand_id", "y").select(*key, F.col("entity_count").alias("holdout_count"), F.col("roc_auc").alias("holdout_auc"))
    return best.join(judged, key, "left").select(*key, "train_auc", "holdout_count", "holdout_auc")


@query(
    f"""WITH every AS ({_EVERY}), subs AS (SELECT a.target_id, a.receptor_id || '+' || b.receptor_id || '+' || c.receptor_id AS subset, [a.receptor_id, b.receptor_id, c.receptor_id] AS m FROM every a JOIN every b ON a.target_id = b.target_id AND a.receptor_id < b.receptor_id JOIN every c ON c.target_id = b.target_id AND b.receptor_id < c.receptor_id), mem AS (SELECT target_id, subset, unnest(m) AS receptor_id FROM subs),
 hit AS (SELECT DISTINCT target_id, subset, ligand_id FROM mem JOIN top USING (target_id, receptor_id)), sc AS (SELECT DISTINCT target_id, ligand_id, y, CAST(CAST('0x' || substr(sha256('series|' || ligand_id), 1, 12) AS BIGINT) % 3 AS INTEGER) AS series FROM lab),
 cov AS (SELECT s.target_id, s.subset, sc.y, sc.series, count(hit.ligand_id) * 1.0 / count(*) AS c FROM subs s JOIN sc USING (target_id) LEFT JOIN hit ON hit.target_id = s.target_id AND hit.subset = s.subset AND hit.ligand_id = sc.ligand_id GROUP BY ALL),
 ex AS (SELECT s.target_id, s.subset, count(hit.ligand_id) * 1.0 / count(*) AS e FROM subs s JOIN (SELECT * FROM sc WHERE y = 0) sc USING (target_id) LEFT JOIN hit ON hit.target_id = s.target_id AND hit.subset = s.subset AND hit.ligand_id = sc.ligand_id GROUP BY ALL)
 SELECT target_id, subset, round(min(c), 9) AS least_coverage, round(avg(c), 9) AS mean_coverage, round(any_value(e), 9) AS exposure, round(0.4 * min(c) + 0.3 * avg(c) - 0.2 * any_value(e), 9) AS objective FROM cov JOIN ex USING (target_id, subset) WHERE y = 1 GROUP BY ALL""",
    "top",
)
def group_objective(spark: SparkSession, d: str) -> DataFrame:
    """Per subset of three receptors: least and mean coverage of the actives of three series, decoy exposure, and the weighted objective."""
    rows = stored_labelled(spark, d).select(*PAIR, "ligand_id", "median_score", "y")
    top = ranking.top_rows(rows, PAIR, "median_score", "ligand_id", 0.1)
    picked = subsets.enumerate_subsets(rows, ["target_id"], "receptor_id", 3)
    series = F.conv(F.substring(F.sha2(F.concat(F.lit("series|"), F.col("ligand_id")), 256), 1, 12), 16, 10).cast("long") % 3
    classed = rows.select("target_id", "ligand_id", "y").distinct().withColumn("series", series)
    groups = [(y, n) for y in (0, 1) for n in range(3)]
    by_group = lambda df, keys, out: df.groupBy("target_id", *keys).agg(*(F.count_if((F.col("y") == y) & (F.col("series") == n)).alias(f"{out}_{y}{n}") for y, n in groups))
    # Entities that any of three receptors hits: hits of one, less those of two, plus those of all three; subsets x hits are never built.
    hits = materialize(top.select(*PAIR, "ligand_id").join(classed, ["target_id", "ligand_id"]), "hits")
    also = lambda m: hits.select("target_id", "ligand_id", F.col("receptor_id").alias(m))
    first = hits.withColumnRenamed("receptor_id", "m1")
    two = first.join(also("m2"), ["target_id", "ligand_id"]).where("m1 < m2")
    three = two.join(also("m3"), ["target_id", "ligand_id"]).where("m2 < m3")
    ones, twos = (materialize(by_group(df, keys, "c"), "common") for df, keys in ((first, ["m1"]), (two, ["m1", "m2"])))
    terms = [(ones, [m], 1) for m in ("m1", "m2", "m3")] + [(twos, [a, b], -1) for a, b in (("m1", "m2"), ("m1", "m3"), ("m2", "m3"))] + [(by_group(three, ["m1", "m2", "m3"], "c"), ["m1", "m2", "m3"], 1)]
    full = picked.join(by_group(classed, [], "n"), "target_id").withColumns({f"h_{y}{n}": F.lit(0).cast("long") for y, n in groups})
    for counted, keys, sign in terms:
        named = counted.select("target_id", *(F.col(f"m{k}").alias(m) for k, m in enumerate(keys, 1)), *(f"c_{y}{n}" for y, n in groups))
        joined = full.join(named, ["target_id", *keys], "left")
        full = joined.select(*(c for c in full.columns if not c.startswith("h_")), *((F.col(f"h_{y}{n}") + sign * F.coalesce(f"c_{y}{n}", F.lit(0))).alias(f"h_{y}{n}") for y, n in groups))
    covered = F.filter(F.array(*(F.try_divide(f"h_1{n}", f"n_1{n}") for n in range(3))), lambda c: c.isNotNull())
    mean = F.try_divide(F.aggregate(covered, F.lit(0.0), lambda a, c: a + c), F.size(covered))
    exposure = F.try_divide(sum(F.col(f"h_0{n}") for n in range(3)), sum(F.col(f"n_0{n}") for n in range(3)))
    out = full.select("target_id", "subset", F.array_min(covered).alias("least_coverage"), mean.alias("mean_coverage"), exposure.alias("exposure"))
    return out.where("least_coverage IS NOT NULL").withColumn("objective", 0.4 * F.col("least_coverage") + 0.3 * F.col("mean_coverage") - 0.2 * F.col("exposure"))


@query(
    """WITH b AS (SELECT target_id, receptor_id AS one FROM (SELECT target_id, receptor_id, row_number() OVER (PARTITION BY target_id ORDER BY count(*) DESC, receptor_id) AS k FROM lab GROUP BY target_id, receptor_id) WHERE k = 1), p AS (SELECT l.target_id, l.ligand_id, l.y, min(median_score) FILTER (receptor_id = one) AS single, min(median_score) AS pair FROM lab l JOIN b USING (target_id) GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY single, ligand_id) AS rs, row_number() OVER (PARTITION BY target_id ORDER BY pair, ligand_id) AS rp FROM p WHERE single IS NOT NULL) SELECT target_id, y, count(*) AS n, count(*) FILTER (pair < single) AS improved, round(avg(rs - rp), 9) AS mean_shift, round(median(rs - rp), 9) AS median_shift FROM r GROUP BY ALL""",
    "lab",
)
def single_against_ensemble(spark: SparkSession, d: str) -> DataFrame:
    """Per target and class: how the rank of an entity shifts from the most used receptor alone to the least score over all receptors."""
    rows = stored_labelled(spark, d)
    counts = rows.groupBy(*PAIR).agg(F.count("*").alias("n"))
    one = ranking.best_groups(counts, ["target_id"], [F.desc("n"), F.asc("receptor_id")], 1).select("target_id", F.col("receptor_id").alias("one"))
    both = rows.join(one, "target_id").groupBy("target_id", "ligand_id", "y").agg(F.min(F.when(F.col("receptor_id") == F.col("one"), F.col("median_score"))).alias("single"), F.min("median_score").alias("pair")).where("single IS NOT NULL")
    placed = row_numbers(row_numbers(both, ["target_id"], ["single", "ligand_id"], "rs"), ["target_id"], ["pair", "ligand_id"], "rp")
    shift = F.col("rs") - F.col("rp")
    return placed.groupBy("target_id", "y").agg(F.count("*").alias("n"), F.count_if(F.col("pair") < F.col("single")).alias("improved"), F.avg(shift).alias("mean_shift"), F.median(shift).alias("median_shift"))


@query()
def superposed_rmsd(spark: SparkSession, d: str) -> DataFrame:
    """Pocket features read as four points: distance of each conformer to the first of its pool, before and after superposition."""
    rows = table(spark, d, "conformers").where("pocket_features IS NOT NULL AND size(pocket_features) = 12").groupBy("pool_id", "conformer_id").agg(F.max("pocket_features").alias("xyz"))
    first = rows.groupBy(F.col("pool_id").alias("grp")).agg(F.min_by("xyz", "conformer_id").alias("ref"))
    return geometry.superposed_rmsd(rows.select(F.col("conformer_id").alias("id"), F.col("pool_id").alias("grp"), "xyz"), first)


def _stream(spark: SparkSession, d: str, name: str) -> tuple[DataFrame, str]:
    """A stream over a table's Parquet files, and a fresh folder for what it writes."""
    folder = f"{scratch_folder(spark).rstrip('/')}/scorelake/stream-{uuid.uuid4().hex}"
    return events.read_stream(spark, f"{d}/{name}.parquet", table(spark, d, name).schema, 4), folder


@query("SELECT target_id, seed_id, ligand_id, receptor_id, gpu_score, status, loaded_at FROM latest", "latest")
def streamed_latest(spark: SparkSession, d: str) -> DataFrame:
    """The keyed table that a stream of score deliveries leaves behind."""
    key = ["target_id", "seed_id", "ligand_id", "receptor_id"]
    stream, folder = _stream(spark, d, "seed_scores")
    events.upsert_stream(stream, folder, key, "loaded_at", f"{folder}-checkpoint")
    return events.latest_version(spark, folder, stream.schema).select(*key, "gpu_score", "status", "loaded_at")


@query("SELECT CAST(strftime(date_trunc('day', ts), '%Y-%m-%d') AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def streamed_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events per day and type, counted by a stream."""
    stream, folder = _stream(spark, d, "events")
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    counted = events.complete_counts(stream, "ts", "event_type", "1 day", folder, f"{folder}-checkpoint")
    return counted.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query(
    """WITH g AS (SELECT target_id, receptor_id, seed_id, avg(score) FILTER (y = 0) - avg(score) FILTER (y = 1) AS gap FROM labcells GROUP BY ALL), s AS (SELECT target_id, receptor_id, count(gap) AS replicates, avg(gap) AS m, stddev_pop(gap) AS sd, count(*) FILTER (gap > 0) * 1.0 / nullif(count(gap), 0) AS support FROM g GROUP BY ALL)
 SELECT target_id, receptor_id, replicates, round(m, 8) AS mean_gap, round(sd, 8) AS deviation, round(support, 8) AS support, round(CASE WHEN support >= 0.6 THEN sign(m) * greatest(abs(m) - 0.5 * sd, 0) ELSE 0 END, 8) + 0.0 AS coefficient, round(CASE WHEN support >= 0.6 AND m - 0.25 * sd >= 0 THEN m - 0.25 * sd END, 8) AS lower_bound FROM s WHERE m IS NOT NULL""",
    "labcells",
)
def stable_coefficients(spark: SparkSession, d: str) -> DataFrame:
    """Per receptor over its replicates: the classes' score gap, soft-thresholded, and its lower bound where most replicates agree."""
    side = lambda v: F.avg(F.when(F.col("y") == v, F.col("score")))
    gaps = labelled_cells(spark, d).groupBy(*PAIR, "seed_id").agg((side(0) - side(1)).alias("gap"))
    rows = gaps.groupBy(*PAIR).agg(F.count("gap").alias("replicates"), F.avg("gap").alias("mean_gap"), F.stddev_pop("gap").alias("deviation"), F.try_divide(F.count_if(F.col("gap") > 0), F.count("gap")).alias("support")).where("mean_gap IS NOT NULL")
    m, sd, s = F.col("mean_gap"), F.col("deviation"), F.col("support")
    low = m - 0.25 * sd
    rows = rows.withColumn("coefficient", soft_threshold(m, sd, s, 0.5, 0.6)).withColumn("lower_bound", F.when((s >= 0.6) & (low >= 0), low))
    return rows.withColumns({c: F.round(c, 8) for c in ("mean_gap", "deviation", "support", "coefficient", "lower_bound")})


@query()
def maxmin_conformers(spark: SparkSession, d: str) -> DataFrame:
    """Per pool: conformers, each the farthest from those before, as many as the largest request asks for; a request of n takes the first n."""
    most = table(spark, d, "selection_requests").agg(F.max("subset_size")).first()[0] or 0
    pairs = geometry.clean_pairs(table(spark, d, "conformer_distances"), "conformer_id_a", "conformer_id_b", "standardized_pocket_distance")
    scoped = geometry.both_ways(pairs).join(members(spark, d).select(F.col("id").alias("a"), "pool_id"), "a")
    return subsets.maxmin_path(scoped, ["pool_id"], most).where(F.col("step") <= most)


@query(
    """WITH h AS (SELECT DISTINCT target_id, ligand_id, y FROM top), n AS (SELECT target_id, count(*) FILTER (y = 1) AS actives, count(*) AS entities FROM (SELECT DISTINCT target_id, ligand_id, y FROM lab) GROUP BY ALL), t AS (SELECT target_id, count(*) FILTER (y = 1) AS hit_actives, count(*) AS hits FROM h GROUP BY ALL)
 SELECT target_id, entities, actives, hits, hit_actives, round(hit_actives * 1.0 / nullif(actives, 0), 9) AS recall, round((hit_actives * 1.0 / hits) / nullif(actives * 1.0 / entities, 0), 9) AS enrichment FROM n JOIN t USING (target_id)""",
    "top",
)
def union_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per target: entities in the top tenth of any receptor, the share of actives among them and their enrichment."""
    rows = stored_labelled(spark, d).select(*PAIR, "ligand_id", "median_score", "y")
    top = ranking.top_rows(rows, PAIR, "median_score", "ligand_id", 0.1)
    whole = rows.select("target_id", "ligand_id", "y").distinct().groupBy("target_id").agg(F.count("*").alias("entities"), F.count_if(F.col("y") == 1).alias("actives"))
    hit = top.select("target_id", "ligand_id", "y").distinct().groupBy("target_id").agg(F.count("*").alias("hits"), F.count_if(F.col("y") == 1).alias("hit_actives"))
    recall = F.try_divide("hit_actives", "actives")
    return whole.join(hit, "target_id").select("target_id", "entities", "actives", "hits", "hit_actives", recall.alias("recall"), F.try_divide(F.col("hit_actives") / F.col("hits"), F.try_divide("actives", "entities")).alias("enrichment"))


@query(
    """WITH g AS (SELECT user_id, ts, event_id, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOURS THEN 0 ELSE 1 END AS n FROM events), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS started, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, k"""
)
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user no more than six hours apart, as sessions."""
    rows = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    # A window of six hours ends before an event exactly six hours later; the microsecond lets that one in.
    by = rows.groupBy("user_id", F.session_window("t", "6 hours 1 microsecond").alias("w"))
    return by.agg(F.min("ts").alias("started"), F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).drop("w")
