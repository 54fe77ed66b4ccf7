"""Runs, trends and running states of ordered events, and summaries over nested scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelake.operators.prefix import running_totals


def state_runs(events: DataFrame, entity: str, time: str, tie: str, state: str) -> DataFrame:
    """(entity, state, runs, longest_run, occupancy, first_time, last_time, revisited): maximal runs of one state.

    Island keys are the difference of two row numbers, both running totals over range-partitioned
    rows, so an entity of any length is spread.
    """
    placed = running_totals(events.select(entity, time, tie, state), [entity], [time, tie], {"__all": None})
    placed = running_totals(placed, [entity, state], [time, tie], {"__own": None})
    runs = placed.groupBy(entity, state, (F.col("__all") - F.col("__own")).alias("__island")).agg(F.count("*").alias("length"), F.min(time).alias("first_time"), F.max(time).alias("last_time"))
    return runs.groupBy(entity, state).agg(F.count("*").alias("runs"), F.max("length").alias("longest_run"), F.sum("length").alias("occupancy"), F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"), (F.count("*") > 1).alias("revisited"))


def trends(events: DataFrame, groups: list[str], time: str, value: str, tie: str) -> DataFrame:
    """Per group: n, first and last value, their difference, least-squares slope per day of the value over time (null for one moment)."""
    order = F.struct(time, tie)
    days = F.unix_micros(F.col(time).cast("timestamp")) / 86_400_000_000.0
    base = events.groupBy(*groups).agg(F.min(days).alias("__t0"))
    rows = events.join(base, groups).withColumn("__t", days - F.col("__t0"))
    v, t = F.col(value), F.col("__t")
    return rows.groupBy(*groups).agg(
        F.count(v).alias("n"), F.min_by(v, order).alias("first_value"), F.max_by(v, order).alias("last_value"), F.when(F.var_pop(t) > 0, F.try_divide(F.covar_pop(v, t), F.var_pop(t))).alias("slope_per_day")
    ).withColumn("delta", F.col("last_value") - F.col("first_value"))


def reveal(cells: DataFrame, scope: list[str], entity: str, step: str, score: str) -> DataFrame:
    """(scope, step, seen, improved, mean_best): scorers revealed in order; state = each entity's least score so far.

    The state of an entity changes at most once per step, so a window per (scope, entity) holds no
    more rows than there are scorers.
    """
    along = Window.partitionBy(*scope, entity).orderBy(step)
    rows = cells.groupBy(*scope, entity, step).agg(F.min(score).alias("own"))
    state = rows.withColumn("before", F.min("own").over(along.rowsBetween(Window.unboundedPreceding, -1))).withColumn("best", F.least("own", F.coalesce("before", "own")))
    return state.groupBy(*scope, step).agg(F.count("*").alias("seen"), F.count_if(F.col("before").isNull() | (F.col("own") < F.col("before"))).alias("improved"), F.avg("best").alias("mean_best"))


def scope_summary(df: DataFrame, scope: str, keys: list[str], value: str, entity: str) -> DataFrame:
    """Every row counted for its own scope and for 'ALL' (grouping sets): rows, distinct entities, mean, share of failures."""
    sets = df.groupingSets([[F.col(k) for k in keys], [F.col(k) for k in (*keys, scope)]], *keys, scope)
    rows = sets.agg(F.grouping(scope).alias("__all"), F.count("*").alias("row_count"), F.countDistinct(entity).alias("entities"), F.avg(value).alias("mean_value"))
    return rows.select(F.when(F.col("__all") == 1, "ALL").otherwise(F.col(scope)).alias("scope"), *keys, "row_count", "entities", "mean_value")


def exactly_one(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` of one row per ``keys``, or an error when it is read."""
    held = df.groupBy(F.lit(1).alias("__one")).agg(F.count("*").alias("__n"), F.max(F.struct(*df.columns)).alias("__row"))
    return held.where(F.coalesce(F.assert_true(F.col("__n") == 1, F.lit(f"not exactly one row of {', '.join(keys)}")).cast("string"), F.lit("")) == "").select("__row.*")


def histogram_thresholds(df: DataFrame, groups: list[str], value: str, densities: list[float]) -> DataFrame:
    """(group, density, threshold): the smallest value whose cumulative count reaches ceil(density * n); values are counted first."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("__c"))
    wanted = running_totals(counts, groups, [value], {"__below": "__c"}, totals=True).withColumn("density", F.explode(F.array(*(F.lit(d) for d in densities))))
    return wanted.where(F.col("__below") + F.col("__c") >= F.ceil(F.col("density") * F.col("__below_all"))).groupBy(*groups, "density").agg(F.min(value).alias("threshold"))


def regret(df: DataFrame, cell: list[str], method: str, value: str, reference: str) -> DataFrame:
    """Adds reference_value (that method's value in the cell, else the least of all) and regret."""
    refs = df.groupBy(*cell).agg(F.coalesce(F.min(F.when(F.col(method) == reference, F.col(value))), F.min(value)).alias("reference_value"))
    return df.join(refs, cell).withColumn("regret", F.col(value) - F.col("reference_value"))


def paired_comparison(df: DataFrame, pair: list[str], scope: list[str], method: str, value: str, left: str, right: str) -> DataFrame:
    """Per scope over pairs that have both methods: n, mean and median of left - right, wins, ties, losses."""
    both = df.groupBy(*dict.fromkeys([*scope, *pair])).agg(F.min(F.when(F.col(method) == left, F.col(value))).alias("l"), F.min(F.when(F.col(method) == right, F.col(value))).alias("r"))
    d = F.col("l") - F.col("r")
    return both.where("l IS NOT NULL AND r IS NOT NULL").groupBy(*scope).agg(F.count("*").alias("n"), F.avg(d).alias("mean_delta"), F.median(d).alias("median_delta"), F.count_if(d < 0).alias("wins"), F.count_if(d == 0).alias("ties"), F.count_if(d > 0).alias("losses"))


def leave_one_out(df: DataFrame, scope: str, option: str, passed: str) -> DataFrame:
    """Per scope: the first option (ascending) that all other scopes pass, or null. Totals minus the own row, no join of scopes."""
    from_all = df.groupBy(option).agg(F.count("*").alias("__n"), F.count_if(F.col(passed)).alias("__ok"))
    own = df.select(scope, option, passed).join(from_all, option)
    rest = own.where((F.col("__n") - 1 > 0) & (F.col("__ok") - F.col(passed).cast("int") == F.col("__n") - 1))
    good = rest.groupBy(scope).agg(F.min(option).alias("chosen"))
    return df.select(scope).distinct().join(good, scope, "left")


def linear_fit(df: DataFrame, groups: list[str], x: list[str], y: str, ridge: float = 0.0) -> DataFrame:
    """Per group: n, coefficients of y on x (one or two columns) with intercept, by normal equations of centred sums."""
    a = F.col(x[0])
    n = F.count(y)
    if len(x) == 1:
        fit = df.groupBy(*groups).agg(n.alias("n"), (F.covar_pop(a, y) * n).alias("xy"), (F.var_pop(a) * n).alias("xx"), F.avg(a).alias("mx"), F.avg(y).alias("my"))
        slope = F.try_divide(F.col("xy"), F.col("xx") + ridge)
        return fit.select(*groups, "n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))
    b = F.col(x[1])
    s = {"aa": F.var_pop(a), "bb": F.var_pop(b), "ab": F.covar_pop(a, b), "ay": F.covar_pop(a, y), "by": F.covar_pop(b, y)}
    fit = df.groupBy(*groups).agg(n.alias("n"), *((c * n).alias(k) for k, c in s.items()), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.avg(y).alias("my"))
    aa, bb, ab, ay, by = F.col("aa") + ridge, F.col("bb") + ridge, F.col("ab"), F.col("ay"), F.col("by")
    det = aa * bb - ab * ab
    first, second = F.try_divide(ay * bb - by * ab, det), F.try_divide(by * aa - ay * ab, det)
    return fit.select(*groups, "n", first.alias("slope_1"), second.alias("slope_2"), (F.col("my") - first * F.col("ma") - second * F.col("mb")).alias("intercept"))


def left_out_fit(df: DataFrame, scope: str, x: str, y: str, ridge: float) -> DataFrame:
    """Per scope: ridge line of y on x fitted on all other scopes, and its root mean square error on the scope's own rows.

    Everything follows from sums per scope: those of the others are the totals less the own. Rows
    with a null are left out; without rows elsewhere the fit is null.
    """
    a, b = F.col(x), F.col(y)
    sums = {"n": F.count(y), "sx": F.sum(x), "sy": F.sum(y), "sxx": F.sum(a * a), "sxy": F.sum(a * b), "syy": F.sum(b * b)}
    own = df.where(a.isNotNull() & b.isNotNull()).groupBy(scope).agg(*(v.alias(k) for k, v in sums.items()))
    whole = own.agg(*(F.sum(k).alias(f"t_{k}") for k in sums))
    c = {k: F.col(f"t_{k}") - F.col(k) for k in sums}
    slope = F.try_divide(c["sxy"] - F.try_divide(c["sx"] * c["sy"], c["n"]), c["sxx"] - F.try_divide(c["sx"] * c["sx"], c["n"]) + ridge)
    fit = own.join(F.broadcast(whole)).select(scope, *sums, c["n"].alias("n_fit"), slope.alias("slope"), (F.try_divide(c["sy"], c["n"]) - slope * F.try_divide(c["sx"], c["n"])).alias("intercept"))
    m, i = F.col("slope"), F.col("intercept")
    squares = F.expr("syy + n * intercept * intercept + slope * slope * sxx - 2 * intercept * sy - 2 * slope * sxy + 2 * slope * intercept * sx")
    return fit.select(scope, F.col("n").alias("n_held_out"), "n_fit", m.alias("slope"), i.alias("intercept"), F.sqrt(F.when(squares > 0, squares / F.col("n")).when(squares <= 0, 0.0)).alias("rmse"))
