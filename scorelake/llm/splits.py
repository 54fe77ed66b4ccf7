"""Train, validation and test splits that keep linked records together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions.text import NO_VALUE, trimmed
from scorelake.llm.components import contract
from scorelake.operators.prefix import running_total
from scorelake.storage import materialize

ID_LINKS = ("split_group_id", "source_molecule_id", "document_id")
EXACT_LINKS = ("scaffold_smiles",)
#: A set with at least this share of all records is placed by deficit, so there are at most 1 / BIG such sets.
BIG = 0.005


def record_id(c: str = "ligand_id") -> Column:
    """Ids in their clean spelling: trimmed and in upper case."""
    return F.upper(trimmed(F.col(c)))


def _known(c: str) -> Column:
    t = trimmed(F.col(c))
    return F.when(~F.lower(t).isin(*NO_VALUE), t)


def link_values(records: DataFrame, key: str = "ligand_id", ids: tuple[str, ...] = ID_LINKS, exact: tuple[str, ...] = EXACT_LINKS) -> DataFrame:
    """Rows (record, value): what each record may share. Ids lose case, blanks and the separators - _ :; exact values only blanks around them."""
    loose = [F.struct(F.lit(c).alias("kind"), F.nullif(F.regexp_replace(F.lower(_known(c)), r"[\s \-_:]", ""), F.lit("")).alias("text")) for c in ids]
    plain = [F.struct(F.lit(c).alias("kind"), _known(c).alias("text")) for c in exact]
    rows = records.select(record_id(key).alias("record"), F.explode(F.array(*loose, *plain)).alias("value"))
    return rows.where(F.col("record").isNotNull() & F.col("value.text").isNotNull())


def linked_sets(records: DataFrame, key: str = "ligand_id", ids: tuple[str, ...] = ID_LINKS, exact: tuple[str, ...] = EXACT_LINKS) -> DataFrame:
    """Rows (record, anchor) of records linked to others; the anchor is the set's smallest record.

    All rows of a record count, so a record delivered twice with different fields links what either
    row names. Values that say 'unknown' in any way, blanks and nulls link nothing; null record ids
    are left out. A value shared by any number of records gives one edge each to its smallest
    record, found by a pre-aggregated minimum, so shared values aren't hot.
    """
    values = link_values(records, key, ids, exact).select("record", F.xxhash64("value.kind", "value.text").alias("k1"), F.xxhash64(F.lit(1), "value.text", "value.kind").alias("k2")).distinct()
    smallest = values.groupBy("k1", "k2").agg(F.min("record").alias("u"))
    edges = values.join(smallest, ["k1", "k2"]).select("u", F.col("record").alias("v"))
    labels = materialize(contract(edges), "labels")
    anchors = labels.groupBy("root").agg(F.min("vertex").alias("anchor"))
    return labels.join(anchors, "root").select(F.col("vertex").alias("record"), "anchor")


def _active() -> Column:
    return F.lower(trimmed(F.col("label"))).isin("active", "1", "1.0", "true", "yes")


def assign_splits(records: DataFrame, targets: DataFrame, seed: int = 7, key: str = "ligand_id") -> DataFrame:
    """Rows (ligand_id, split_name, anchor): every record once, linked sets whole.

    The sets are ordered by a hash and cut where their cumulative weight passes the targets' shares
    (normalized to sum to 1; nulls and negative ones count as 0). Sets with actives are weighed by
    their actives first, then the others by size against what is still missing, so both the sizes
    and the shares of actives come near the targets. The few sets above a fixed share of all records
    go first, each to the split that lacks most. Without targets nothing is assigned.
    """
    split_rows = [(r.split_name, max(0.0, r.target_share or 0.0)) for r in targets.select("split_name", "target_share").orderBy("split_name").collect()]
    share_sum = sum(s for _, s in split_rows) or 1.0
    shares = [(n, s / share_sum) for n, s in split_rows if s > 0]
    once = records.select(record_id(key).alias("record"), F.coalesce(_active(), F.lit(False)).alias("active")).where(F.col("record").isNotNull()).groupBy("record").agg(F.max("active").alias("active"))
    members = materialize(once.join(linked_sets(records, key), "record", "left").select("record", "active", F.coalesce("anchor", "record").alias("anchor")), "members")
    sets = members.groupBy("anchor").agg(F.count("*").alias("size"), F.count_if("active").alias("actives"))
    sets = materialize(sets.withColumn("draw", F.xxhash64(F.lit(seed), "anchor")), "sets")
    total = sets.agg(F.sum("size").alias("size"), F.sum("actives").alias("actives")).first()
    if not shares or not total.size:
        return members.select(F.col("record").alias("ligand_id"), F.lit(None).cast("string").alias("split_name"), "anchor").where(F.lit(False))
    # Bounded: at most 1 / BIG rows have that share of all records.
    big = sets.where(F.col("size") >= max(2, BIG * total.size)).orderBy(F.desc("size"), "anchor").collect()
    missing = {n: [s * total.size, s * (total.actives or 0)] for n, s in shares}
    placed = []
    for row in big:
        lack = lambda n: (missing[n][0] / total.size) + (missing[n][1] / total.actives if total.actives and row.actives else 0)
        best = max(missing, key=lambda n: (lack(n), n))
        missing[best][0] -= row.size
        missing[best][1] -= row.actives
        placed.append((row.anchor, best))
    spark = records.sparkSession
    out = [spark.createDataFrame(placed, "anchor string, split_name string")] if placed else []
    rest = sets.where(F.col("size") < max(2, BIG * total.size))
    for weight, condition in (("actives", F.col("actives") > 0), ("size", F.col("actives") == 0)):
        at = 1 if weight == "actives" else 0
        own = running_total(rest.where(condition), [], ["draw", "anchor"], weight, "before")
        own = materialize(own, "weighed")
        weights = own.agg(F.sum(weight)).first()[0] or 0
        need = {n: max(0.0, m[at]) for n, m in missing.items()}
        scale = weights / (sum(need.values()) or 1.0)
        if not sum(need.values()):
            need, scale = dict(shares), float(weights)
        choice, upto = F.lit(None).cast("string"), 0.0
        bounds = []
        for n, x in need.items():
            upto += x * scale
            bounds.append((upto, n))
        middle = F.col("before") + F.col(weight) / 2
        for bound, n in reversed(bounds):
            choice = F.when(middle <= bound, F.lit(n)).otherwise(choice)
        named = materialize(own.select("anchor", "size", "actives", F.coalesce(choice, F.lit(bounds[-1][1])).alias("split_name")), "placed")
        for r in named.groupBy("split_name").agg(F.sum("size").alias("size"), F.sum("actives").alias("actives")).collect():
            missing[r.split_name][0] -= r["size"]
            missing[r.split_name][1] -= r.actives
        out.append(named.select("anchor", "split_name"))
    every = out[0]
    for more in out[1:]:
        every = every.unionAll(more)
    return members.join(every, "anchor").select(F.col("record").alias("ligand_id"), "split_name", "anchor")


def split_report(assigned: DataFrame, records: DataFrame, key: str = "ligand_id") -> DataFrame:
    """Per split: records, actives, their shares of all."""
    label = records.select(record_id(key).alias("ligand_id"), F.coalesce(_active(), F.lit(False)).alias("active")).groupBy("ligand_id").agg(F.max("active").alias("active"))
    sizes = assigned.join(label, "ligand_id").groupBy("split_name").agg(F.count("*").alias("records"), F.count_if("active").alias("actives"))
    whole = Window.partitionBy()  # one row per split
    return sizes.select("split_name", "records", "actives", (F.col("records") / F.sum("records").over(whole)).alias("record_share"), F.try_divide(F.col("actives"), F.sum("actives").over(whole)).alias("active_share"))
