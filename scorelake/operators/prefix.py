"""Running totals, row numbers and carried values over groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.storage import materialize


def _starts(batch: pa.RecordBatch, groups: list[str], last: list[pa.Scalar] | None) -> np.ndarray:
    """Whether each row is the first of its group within the partition; nulls are equal."""
    first = np.zeros(batch.num_rows, bool)
    first[0] = last is None
    for i, g in enumerate(groups):
        column = batch.column(g)
        before = pa.concat_arrays([pa.array([last[i].as_py() if last else None], column.type), column.slice(0, len(column) - 1)])
        same_null = pc.and_(pc.is_null(column), pc.is_null(before))
        differs = pc.if_else(same_null, False, pc.fill_null(pc.not_equal(column, before), True)).to_numpy(zero_copy_only=False)
        first |= differs if last else np.concatenate([[True], differs[1:]])
    return first


def _within(groups: list[str], sums: list[str], carried: list[str], names: list[str]):
    """Sums in front of a row and last known values up to it, within its group and partition; rows come sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        total: dict[str, float | int] = dict.fromkeys(sums, 0)
        known: dict[str, object] = dict.fromkeys(carried)
        for b in batches:
            if not b.num_rows:
                continue
            first, out = _starts(b, groups, last), []
            rows = np.arange(b.num_rows)
            start = np.maximum.accumulate(np.where(first, rows, -1))  # of the row's group; -1: in an earlier batch
            for s in sums:
                w = b.column(f"__w_{s}").to_numpy(zero_copy_only=False)
                ahead = np.concatenate([np.zeros(1, w.dtype), np.cumsum(w)])
                inside = ahead[:-1] - np.where(start >= 0, ahead[np.maximum(start, 0)], w.dtype.type(-total[s]))
                total[s] = (inside[-1] + w[-1]).item()
                out.append(pa.array(inside))
            for c in carried:
                column = b.column(f"__c_{c}")
                valid = np.where(column.is_valid().to_numpy(zero_copy_only=False), rows, -1)
                at = np.maximum.accumulate(valid)
                at = np.where(at >= np.maximum(start, 0), at + 1, np.where(start >= 0, -1, 0))  # 0: the value of an earlier batch
                values = pa.concat_arrays([pa.array([known[c]], column.type), column]).take(pa.array(at, mask=at < 0))
                known[c] = values[-1].as_py()
                out.append(values)
            last = [b.column(g)[b.num_rows - 1] for g in groups]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), *out], names)

    return run


def _running(df: DataFrame, groups: list[str], order: list[str], weights: dict[str, str | None], carried: dict[str, str], totals: bool) -> DataFrame:
    kinds = dict(df.dtypes)
    real = lambda w: w is not None and kinds[w] in ("double", "float")
    value = {o: F.lit(1).cast("long") if w is None else F.coalesce(F.col(w).cast("double" if real(w) else "long"), F.lit(0)) for o, w in weights.items()}
    wide = df.select("*", *(v.cast("double" if real(weights[o]) else "long").alias(f"__w_{o}") for o, v in value.items()), *(F.col(c).alias(f"__c_{o}") for o, c in carried.items()))
    ranged = wide.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order)
    names = [*wide.columns, "__part", *(f"__i_{o}" for o in weights), *(f"__k_{o}" for o in carried)]
    fields = [T.StructField("__part", T.IntegerType()), *(T.StructField(f"__i_{o}", wide.schema[f"__w_{o}"].dataType) for o in weights), *(T.StructField(f"__k_{o}", wide.schema[f"__c_{o}"].dataType) for o in carried)]
    nullable = [T.StructField(f.name, f.dataType, True) for f in wide.schema]
    parts = materialize(ranged.mapInArrow(_within(groups, list(weights), list(carried), names), T.StructType([*nullable, *fields])), "ranged")
    by_part = parts.groupBy(*groups, "__part").agg(*(F.sum(f"__w_{o}").alias(f"__w_{o}") for o in weights), *(F.max_by(f"__k_{o}", F.when(F.col(f"__k_{o}").isNotNull(), F.struct(*order))).alias(f"__l_{o}") for o in carried))
    earlier = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # A border between partitions cuts one group at most, so there are fewer starts than partitions.
    start = by_part.select(*groups, "__part", F.count("*").over(earlier).alias("__parts"), *(F.sum(f"__w_{o}").over(earlier).alias(f"__s_{o}") for o in weights), *(F.last(f"__l_{o}", ignorenulls=True).over(earlier).alias(f"__e_{o}") for o in carried)).where("__parts > 0")
    same = lambda keys, a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in keys]
    joined = parts.alias("w").join(F.broadcast(start).alias("s"), same([*groups, "__part"], "w", "s"), "left")
    sums = [(F.col(f"w.__i_{o}") + F.coalesce(F.col(f"s.__s_{o}"), F.lit(0))).alias(o) for o in weights]
    last = [F.coalesce(F.col(f"w.__k_{o}"), F.col(f"s.__e_{o}")).alias(o) for o in carried]
    if not totals:
        return joined.select(*(F.col(f"w.{c}") for c in df.columns), *sums, *last)
    whole = by_part.groupBy(*groups).agg(*(F.sum(f"__w_{o}").alias(f"__t_{o}") for o in weights))
    every = joined.join(whole.alias("t"), same(groups, "w", "t") or F.lit(True))  # without groups ``whole`` is one row
    return every.select(*(F.col(f"w.{c}") for c in df.columns), *sums, *last, *(F.col(f"t.__t_{o}").alias(f"{o}_all") for o in weights))


def running_totals(df: DataFrame, groups: list[str], order: list[str], weights: dict[str, str | None], totals: bool = False) -> DataFrame:
    """Adds a column per entry of ``weights``: the sum of that column (of 1, if None) over the rows in front, within a group, in the given order; with ``totals`` also ``<name>_all``, the group's whole sum.

    Rows are range-partitioned by group and order, so a hot group is spread over many tasks, and
    sorted there once; sums run on within a partition, batch by batch. What earlier partitions hold
    of a partition's first group is added by a table of fewer rows than there are partitions. Ties in
    ``order`` get different totals in an undefined order: give a total order. Null weights count as
    0; null groups are groups; an empty table stays empty.
    """
    return _running(df, groups, order, weights, {}, totals)


def running_total(df: DataFrame, groups: list[str], order: list[str], weight: str | None = None, out: str = "before") -> DataFrame:
    """``running_totals`` of one weight."""
    return running_totals(df, groups, order, {out: weight})


def row_numbers(df: DataFrame, groups: list[str], order: list[str], out: str = "rank") -> DataFrame:
    """Adds ``out``: 1, 2, ... within a group of any size, in a total order."""
    return running_totals(df, groups, order, {out: None}).withColumn(out, F.col(out) + 1)


def carried_values(df: DataFrame, groups: list[str], order: list[str], carried: dict[str, str]) -> DataFrame:
    """Adds a column per entry of ``carried``: the last value of that column that isn't null, up to and with the row, within a group of any size; null where none came yet."""
    return _running(df, groups, order, {}, carried, False)
