"""Ranks and ranking metrics over groups of any size.

Orders are (score ascending, id ascending). Ranks come from running totals over range-partitioned
rows, so the rows of a hot scorer are spread; what then remains are plain aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.operators.prefix import running_total, running_totals


def value_ranks(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Per group and different value: less (rows below), equal (rows with it), n (rows of the group).

    Rows are counted by value before any order is made. From these follow the competition rank
    less + 1, the average rank less + (equal + 1) / 2, the share of values <= it (less + equal) / n.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("equal"))
    return running_totals(counts, groups, [value], {"less": "equal"}, totals=True).withColumnRenamed("less_all", "n")


def ranked(df: DataFrame, groups: list[str], value: str, tie: str) -> DataFrame:
    """Adds position (1.. by value, then ``tie``), competition_rank, average_rank, share_at_most, rank_fraction ((position-1)/(n-1), 0 for one row)."""
    placed = running_total(df.where(F.col(value).isNotNull()), groups, [value, tie], None, "__before")
    rows = placed.join(value_ranks(df, groups, value), [*groups, value])
    less, equal, n = F.col("less"), F.col("equal"), F.col("n")
    return rows.select(
        *df.columns, (F.col("__before") + 1).alias("position"), (less + 1).alias("competition_rank"), (less + (equal + 1) / 2).alias("average_rank"), ((less + equal) / n).alias("share_at_most"), F.coalesce(F.try_divide(F.col("__before"), n - 1), F.lit(0.0)).alias("rank_fraction")
    )


def train_rank_transform(train: DataFrame, apply: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Adds mid_rank = (less + equal/2 + 1/2) / (n + 1) and share_at_most = (less + equal) / n of the training values, for any rows.

    Training rows are counted by value; values to transform are merged into that order by one
    running total. Groups without training rows give null.
    """
    counts = train.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("equal"))
    probes = apply.where(F.col(value).isNotNull()).select(*groups, value).distinct()
    merged = probes.join(counts, [*groups, value], "full_outer")
    table = running_totals(merged, groups, [value], {"less": "equal"}, totals=True)
    less, equal, n = F.col("less"), F.coalesce("equal", F.lit(0)), F.nullif(F.col("less_all"), F.lit(0))
    table = table.select(*groups, value, ((less + equal / 2 + 0.5) / (n + 1)).alias("mid_rank"), ((less + equal) / n).alias("share_at_most"))
    return apply.join(table, [*groups, value], "left").select(*apply.columns, "mid_rank", "share_at_most")


def _bedroc(alpha: float) -> tuple[Column, Column]:
    """Best and worst attainable sums of exp(-alpha*rank/N) for p positives among N, as geometric series."""
    q = F.exp(-alpha / F.col("n"))
    series = F.try_divide(q * (1 - F.pow(q, F.col("p"))), 1 - q)
    return series, series * F.pow(q, F.col("n") - F.col("p"))


def screening_metrics(df: DataFrame, groups: list[str], score: str, entity: str, y: str, fractions: tuple[float, ...] = (0.01, 0.05, 0.1), alpha: float = 20.0, top: int = 10) -> DataFrame:
    """Per group: entity and active counts, ROC-AUC, average precision, BEDROC, enrichment factors, actives among the first ``top``.

    Null scores and labels are left out; metrics that need both classes are null where one is
    missing. AUC counts ties as half; the others break them by id.
    """
    rows = df.where(F.col(score).isNotNull() & F.col(y).isNotNull())
    slim = rows.select(*groups, score, entity, y)
    full = running_totals(slim, groups, [score, entity], {"__r": None, "__hits": y}, totals=True).withColumnsRenamed({"__r_all": "n", "__hits_all": "p"})
    r, hits = F.col("__r") + 1, F.col("__hits") + F.col(y)
    cut = {f: F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(f))) for f in fractions}
    name = {f: "ef" + f"{f * 100:g}".replace(".", "_") for f in fractions}
    # Ties count by value: the mean position of the rows that share a score.
    by_value = full.groupBy(*groups, score).agg(
        F.avg(r).alias("mid"), F.sum(y).alias("a"), F.first("n").alias("n"), F.first("p").alias("p"), F.sum(F.when(F.col(y) == 1, hits / r)).alias("ap"), F.sum(F.when(F.col(y) == 1, F.exp(-alpha * r / F.col("n")))).alias("e"),
        *(F.count_if((F.col(y) == 1) & (r <= cut[f])).alias(name[f]) for f in fractions), F.count_if((F.col(y) == 1) & (r <= top)).alias("t"),
    )
    one = by_value.groupBy(*groups).agg(
        F.first("n").alias("n"), F.first("p").alias("p"), F.sum(F.col("mid") * F.col("a")).alias("ranks"), F.sum("ap").alias("ap"), F.sum("e").alias("e"), *(F.sum(name[f]).alias(name[f]) for f in fractions), F.sum("t").alias("t")
    )
    n, p = F.col("n"), F.col("p")
    best, worst = _bedroc(alpha)
    both = (p > 0) & (p < n)
    return one.select(
        *groups, n.alias("entity_count"), p.alias("active_count"), F.when(both, 1 - F.try_divide(F.col("ranks") - p * (p + 1) / 2, p * (n - p))).alias("roc_auc"), F.try_divide("ap", p).alias("average_precision"),
        F.when(both, F.try_divide(F.col("e") - worst, best - worst)).alias("bedroc"), *(F.try_divide(F.try_divide(F.col(name[f]), cut[f]), F.try_divide(p, n)).alias(name[f]) for f in fractions), F.col("t").alias(f"top{top}_active_count"),
    )


def top_rows(df: DataFrame, groups: list[str], score: str, entity: str, fraction: float) -> DataFrame:
    """The first max(1, ceil(n * fraction)) rows of each group by (score, id), with their position."""
    rows = df.where(F.col(score).isNotNull())
    placed = running_totals(rows, groups, [score, entity], {"__before": None}, totals=True)
    return placed.where(F.col("__before") < F.greatest(F.lit(1), F.ceil(F.col("__before_all") * F.lit(fraction)))).select(*df.columns, (F.col("__before") + 1).alias("position"))


def best_groups(metrics: DataFrame, scope: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each scope (a summary table: one row per scorer) in the given order, with their rank."""
    return metrics.withColumn("rank", F.row_number().over(Window.partitionBy(*scope).orderBy(*order))).where(F.col("rank") <= k)


def pearson(x: Column, y: Column) -> Column:
    """Correlation from sums; null where one side is constant."""
    n = F.count_if(x.isNotNull() & y.isNotNull())
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    top = F.sum(a * b) - F.try_divide(F.sum(a) * F.sum(b), n)
    va, vb = F.var_pop(a) * n, F.var_pop(b) * n
    return F.when((va > 1e-18) & (vb > 1e-18), F.try_divide(top, F.sqrt(va * vb)))
