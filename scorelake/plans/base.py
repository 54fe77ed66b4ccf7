"""Shared inputs of the score queries: DataFrames and the same as SQL common table expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions.numbers import ASIDE, settled
from scorelake.operators import scores
from scorelake.sources.tables import table
from scorelake.storage import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 9 places, as sums differ in their last digits between engines and partitions; no negative zero."""
    return df.select(*((settled(c) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(sql: str | None = None, base: str = "") -> Callable[[Query], Query]:
    """Register a query; ``sql`` may use the common table expressions named in ``base``."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, folder: rounded(f(spark, folder))
        if sql:
            ctes = ", ".join(f"{n} AS ({_aside(CTES[n])})" for n in _closure(base.split()))
            body = sql.strip()
            body = _aside(body)
            recursive = "RECURSIVE " if body.upper().startswith("WITH RECURSIVE ") else ""
            rest = ", " + body[5 + len(recursive) :] if body.upper().startswith("WITH ") else " " + body
            SQL[f.__name__] = f"WITH {recursive}{ctes}{rest}" if ctes else body
        return f

    return add


def _aside(sql: str) -> str:
    """The SQL form of ``settled``: every ``round(x, 9)`` becomes ``round(x + ASIDE, 9)``."""
    return sql.replace(", 9)", f" + {ASIDE!r}, 9)")


_NEEDS = {"cells": ["latest"], "summary": ["cells"], "lab": ["summary", "labels"], "labcells": ["cells", "labels"], "metrics": ["lab"], "seedmetrics": ["labcells"], "top": ["lab"], "profile": ["seedmetrics"], "pairs": [], "ranks": ["labcells"], "utility": ["ranks"], "best3": ["metrics"]}


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        for m in [*_closure(_NEEDS.get(n, [])), n]:
            if m not in out:
                out.append(m)
    return out


def _metrics_sql(source: str, groups: str, score: str) -> str:
    g = ", ".join(f"a.{x.strip()}" for x in groups.split(","))
    return f"""
SELECT {groups}, CAST(max(n) AS BIGINT) AS entity_count, CAST(max(p) AS BIGINT) AS active_count,
 round(CASE WHEN max(p) > 0 AND max(p) < max(n) THEN 1 - (sum(CASE WHEN y = 1 THEN mid END) - max(p) * (max(p) + 1) / 2.0) / (max(p) * (max(n) - max(p))) END, 9) AS roc_auc,
 round(CASE WHEN max(p) > 0 THEN sum(CASE WHEN y = 1 THEN cum * 1.0 / r END) / max(p) END, 9) AS average_precision,
 round(CASE WHEN max(p) > 0 AND max(p) < max(n) THEN (sum(CASE WHEN y = 1 THEN w ELSE 0 END) - sum(CASE WHEN r > n - p THEN w ELSE 0 END)) / (sum(CASE WHEN r <= p THEN w ELSE 0 END) - sum(CASE WHEN r > n - p THEN w ELSE 0 END)) END, 9) AS bedroc,
 {", ".join(f"round(CASE WHEN max(p) > 0 THEN (count(*) FILTER (y = 1 AND r <= greatest(1, ceil(n * CAST({f} AS DOUBLE)))) / greatest(1, ceil(max(n) * CAST({f} AS DOUBLE)))) / (max(p) * 1.0 / max(n)) END, 9) AS {name}" for f, name in ((0.01, "ef1"), (0.05, "ef5"), (0.1, "ef10")))},
 CAST(count(*) FILTER (y = 1 AND r <= 10) AS BIGINT) AS top10_active_count
FROM (SELECT *, exp(-20.0 * r / n) AS w, avg(r) OVER (PARTITION BY {groups}, {score}) AS mid FROM (
 SELECT {groups}, ligand_id, {score}, y, row_number() OVER (PARTITION BY {groups} ORDER BY {score}, ligand_id) AS r, count(*) OVER (PARTITION BY {groups}) AS n, sum(y) OVER (PARTITION BY {groups}) AS p,
 sum(y) OVER (PARTITION BY {groups} ORDER BY {score}, ligand_id ROWS UNBOUNDED PRECEDING) AS cum FROM {source})) AS a GROUP BY {groups}"""


CTES = {
    "latest": "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY target_id, seed_id, ligand_id, receptor_id ORDER BY loaded_at DESC NULLS LAST, gpu_score DESC NULLS LAST, status DESC NULLS LAST) AS rn FROM seed_scores) WHERE rn = 1",
    "cells": "SELECT target_id, seed_id, ligand_id, receptor_id, gpu_score AS score FROM latest WHERE lower(status) <> 'failed' AND gpu_score IS NOT NULL AND NOT isnan(gpu_score)",
    "labels": "SELECT ligand_id, y, split_group_id FROM (SELECT *, row_number() OVER (PARTITION BY ligand_id ORDER BY loaded_at DESC NULLS LAST, y DESC, split_group_id DESC NULLS LAST) AS rn FROM (SELECT ligand_id, CASE WHEN lower(trim(label)) IN ('active', '1') THEN 1 WHEN lower(trim(label)) IN ('decoy', 'inactive', '0') THEN 0 END AS y, upper(trim(split_group_id)) AS split_group_id, loaded_at FROM ligands) WHERE y IS NOT NULL) WHERE rn = 1",
    "summary": "SELECT target_id, ligand_id, receptor_id, count(*) AS replicate_count, round(median(score), 9) AS median_score, min(score) AS minimum_score, max(score) AS maximum_score, arg_min(seed_id, (score, seed_id)) AS best_replicate, max(score) - min(score) AS score_range FROM cells GROUP BY ALL",
    "lab": "SELECT s.*, l.y, l.split_group_id FROM summary s JOIN labels l USING (ligand_id)",
    "labcells": "SELECT c.*, l.y FROM cells c JOIN labels l USING (ligand_id)",
    "metrics": _metrics_sql("lab", "target_id, receptor_id", "median_score"),
    "seedmetrics": _metrics_sql("labcells", "target_id, receptor_id, seed_id", "score"),
    "top": "SELECT target_id, receptor_id, ligand_id, median_score, y, r AS position FROM (SELECT *, row_number() OVER (PARTITION BY target_id, receptor_id ORDER BY median_score, ligand_id) AS r, count(*) OVER (PARTITION BY target_id, receptor_id) AS n FROM lab) WHERE r <= greatest(1, ceil(n * CAST(0.1 AS DOUBLE)))",
    "profile": "SELECT target_id, seed_id AS fold, CAST(k AS INTEGER) AS k, avg(roc_auc) OVER (PARTITION BY target_id, seed_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS value FROM (SELECT *, row_number() OVER (PARTITION BY target_id, seed_id ORDER BY roc_auc DESC, receptor_id) AS k FROM seedmetrics WHERE roc_auc IS NOT NULL)",
    "ranks": "SELECT target_id, receptor_id, seed_id, ligand_id, y, row_number() OVER (PARTITION BY target_id, receptor_id, seed_id ORDER BY score, ligand_id) * 1.0 / count(*) OVER (PARTITION BY target_id, receptor_id, seed_id) AS r FROM labcells",
    "utility": "SELECT target_id, receptor_id, count(*) AS replicates, round((avg(u) + min(u)) / 2, 9) AS utility FROM (SELECT target_id, receptor_id, seed_id, avg(exp(-20.0 * r)) FILTER (y = 1) - avg(exp(-20.0 * r)) FILTER (y = 0) AS u FROM ranks GROUP BY ALL) WHERE u IS NOT NULL GROUP BY ALL",
    "best3": "SELECT target_id, receptor_id FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY roc_auc DESC NULLS LAST, average_precision DESC NULLS LAST, receptor_id) AS k FROM metrics) WHERE k <= 3",
    "pairs": "SELECT least(conformer_id_a, conformer_id_b) AS a, greatest(conformer_id_a, conformer_id_b) AS b, min(standardized_pocket_distance) AS distance FROM conformer_distances WHERE conformer_id_a <> conformer_id_b AND standardized_pocket_distance IS NOT NULL AND NOT isnan(standardized_pocket_distance) GROUP BY ALL",
    "twoway": "SELECT a, b, distance FROM pairs UNION ALL SELECT b, a, distance FROM pairs",
    "members": "SELECT conformer_id AS id, min(pool_id || '/' || source_type) AS cluster, min(pool_id) AS pool_id, min(resolution_angstrom) AS quality FROM conformers GROUP BY ALL",
}
_NEEDS["twoway"] = ["pairs"]


def cells(spark: SparkSession, folder: str) -> DataFrame:
    return scores.score_cells(table(spark, folder, "seed_scores"))


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return scores.binary_labels(table(spark, folder, "ligands"))


def summary(spark: SparkSession, folder: str) -> DataFrame:
    return scores.replicate_summary(cells(spark, folder))


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    return summary(spark, folder).join(labels(spark, folder), "ligand_id")


def stored_labelled(spark: SparkSession, folder: str) -> DataFrame:
    """``labelled`` for queries that read it more than once: target_id, receptor_id, ligand_id, median_score, y, aggregated once and stored."""
    return materialize(labelled(spark, folder).select("target_id", "receptor_id", "ligand_id", "median_score", "y"), "labelled")


def labelled_cells(spark: SparkSession, folder: str) -> DataFrame:
    return cells(spark, folder).join(labels(spark, folder), "ligand_id")


def members(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conformers")
    return rows.groupBy(F.col("conformer_id").alias("id")).agg(F.min(F.concat_ws("/", "pool_id", "source_type")).alias("cluster"), F.min("pool_id").alias("pool_id"), F.min("resolution_angstrom").alias("quality"))
