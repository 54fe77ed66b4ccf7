"""Differences between two copies of a table, by set reconciliation.

Each side reduces its rows to hashes of (key, compared values), keeps the latest delivery of a key
and groups the hashes into buckets of a few dozen. The sides exchange, for each bucket, only the
values of the bucket's characteristic polynomial prod(z - hash) at a few points of the field of
2**61 - 1 elements. The quotient of both polynomials is the quotient of those of the hashes that one
side lacks: it is interpolated and its roots are the differing hashes. A bucket whose quotient can't
be verified at the spare points is sketched again with twice the points. Rows of differing hashes
are then fetched from both sides and compared field by field.

Work: one shuffle of 40 bytes a row (latest delivery), one of 16 bytes a row (buckets), and what the
differences need. A key delivered any number of times is pre-aggregated before the shuffle, and
buckets hold distinct keys, so no key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions import field61 as field
from scorelake.functions.text import folded, hex_digits, number, trimmed
from scorelake.storage import materialize

#: Recovered hashes up to this number are broadcast to the scans that fetch rows (some 50 MB as a hash relation); more are joined by a shuffle.
BROADCAST_HASHES = 500_000
SPARE = 2
#: Into how many a bucket is split whose differences exceed the last bound.
SPLIT = 16


@dataclass(frozen=True)
class Key:
    """Part of the key; ``spell``: upper, lower or tail_lower (upper case before the last '_')."""

    name: str
    spell: str = "upper"


@dataclass(frozen=True)
class Field:
    """Compared field; ``kind``: number (differing by more than ``tolerance``), text, hex or time."""

    name: str
    kind: str = "text"
    tolerance: float = 1e-6


def _key_text(key: list[Key]) -> Column:
    return F.concat_ws("|", *(F.coalesce(F.lower(trimmed(F.col(k.name))), F.lit("")) for k in key))


def _spelled(key: list[Key]) -> Column:
    def one(k: Key, part: Column) -> Column:
        if k.spell == "lower":
            return part
        if k.spell == "upper":
            return F.upper(part)
        tail = F.element_at(F.split(part, "_"), -1)
        head = F.substring(part, F.lit(1), F.length(part) - F.length(tail))
        return F.concat(F.upper(head), tail)

    parts = F.split(F.col("record"), "[|]", len(key))
    return F.concat_ws("|", *(one(k, F.element_at(parts, i + 1)) for i, k in enumerate(key)))


def _values(fields: list[Field]) -> list[Column]:
    """Comparable values: a double for numbers, else a text; unreadable text in a number field stays a text of its own."""
    out = []
    for f in fields:
        c = F.col(f.name)
        if f.kind == "number":
            out += [number(c).alias(f"{f.name}__n"), F.when(number(c).isNull(), folded(c)).alias(f"{f.name}__t")]
        elif f.kind == "time":
            out.append(F.unix_micros(c.cast("timestamp")).cast("string").alias(f"{f.name}__t"))
        else:
            out.append((hex_digits(c) if f.kind == "hex" else folded(c)).alias(f"{f.name}__t"))
    return out


def _element(fields: list[Field]) -> Column:
    """Hash of key and values in [0, 2**60). Numbers enter as the cell of a grid of the tolerance's width: equal cells can't differ by more."""
    parts = [F.col("record")]
    for f in fields:
        if f.kind == "number":
            parts.append(F.coalesce(F.rint(F.col(f"{f.name}__n") / F.lit(f.tolerance)).cast("string"), F.lit("\x00")))
        parts.append(F.coalesce(F.col(f"{f.name}__t"), F.lit("\x00")))
    return F.xxhash64(F.concat_ws("\x01", *parts)).bitwiseAND(F.lit(field.ELEMENTS - 1))


def _canonical(df: DataFrame, key: list[Key], fields: list[Field], version: str) -> DataFrame:
    rows = df.select(_key_text(key).alias("record"), F.unix_micros(F.col(version).cast("timestamp")).alias("version"), *_values(fields))
    return rows.withColumn("element", _element(fields))


def _sketch(count: int):
    at = field.points(count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("elements")
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy()
            e = field.characteristic(values[offsets[0] : offsets[-1]], offsets - offsets[0], at)
            evaluated = pa.ListArray.from_arrays(pa.array(np.arange(0, e.size + 1, count, dtype=np.int32)), pa.array(e.ravel().astype(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("side"), b.column("bucket"), pa.array(np.diff(offsets).astype(np.int32)), evaluated], ["side", "bucket", "n", "evaluated"])

    return run


def _solver(count: int):
    at = field.points(count)

    def matrix(column: pa.Array) -> np.ndarray:
        return np.array([[1] * count if x is None else x for x in column.to_pylist()], np.int64).astype(np.uint64).reshape(-1, count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            na, nb = (np.array([x or 0 for x in b.column(c).to_pylist()], np.int64) for c in ("na", "nb"))
            found = field.difference(na, nb, matrix(b.column("ea")), matrix(b.column("eb")), at, SPARE)
            lists = (pa.array([x[i] if x else [] for x in found], pa.list_(pa.int64())) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column("bucket"), pa.array([x is not None for x in found]), *lists, pa.array(np.abs(na - nb).astype(np.int32))], ["bucket", "verified", "only_primary", "only_mirror", "least"])

    return run


def differing_elements(elements: DataFrame, first_bound: int = 6, last_bound: int = 48) -> list[DataFrame]:
    """Tables (side, element) of the hashes that only one side has.

    ``elements``: side (0, 1), bucket, elements (array of distinct hashes), a stored table. The bound
    on a bucket's differences starts at ``first_bound`` and doubles until all buckets are verified;
    buckets beyond ``last_bound`` are split by further bits of a hash and sketched anew, so a side
    that is empty or late by any number of rows is reconciled by the same method. The sizes of a
    bucket differ by no more than its differences, so bounds below that are passed over.
    """
    out, bound, left, splits = [], first_bound, elements, 0
    one = lambda c, s: F.first(F.when(F.col("side") == s, F.col(c)), ignorenulls=True)
    while True:
        count = bound + SPARE
        sketches = left.select("side", "bucket", "elements").mapInArrow(_sketch(count), "side int, bucket long, n int, evaluated array<long>")
        both = sketches.groupBy("bucket").agg(one("n", 0).alias("na"), one("evaluated", 0).alias("ea"), one("n", 1).alias("nb"), one("evaluated", 1).alias("eb"))
        same = both.where(~(F.col("na").eqNullSafe(F.col("nb")) & F.col("ea").eqNullSafe(F.col("eb"))))
        solved = materialize(same.mapInArrow(_solver(count), "bucket long, verified boolean, only_primary array<long>, only_mirror array<long>, least int"), "reconciled")
        good = solved.where("verified")
        out.append(good.select(F.lit(0).alias("side"), F.explode("only_primary").alias("element")).unionAll(good.select(F.lit(1).alias("side"), F.explode("only_mirror").alias("element"))))
        failed = solved.where(~F.col("verified")).select("bucket", "least")
        least = failed.agg(F.min("least")).first()[0]
        if least is None:
            return out
        left = left.join(failed.select("bucket"), "bucket", "left_semi")
        bound *= 2
        while bound < least and bound <= last_bound:
            bound *= 2
        if bound > last_bound:
            if splits == 12:
                raise RuntimeError("buckets that no split separates")
            single = left.select("side", "bucket", F.explode("elements").alias("element"))
            finer = F.xxhash64("bucket", F.pmod(F.xxhash64("element", F.lit(splits)), F.lit(SPLIT)))
            left = materialize(single.groupBy("side", finer.alias("bucket")).agg(F.collect_list("element").alias("elements")), "split")
            bound, splits = first_bound, splits + 1


def reconcile(primary: DataFrame, mirror: DataFrame, key: list[Key], fields: list[Field], version: str, bucket_rows: int = 40) -> DataFrame:
    """Rows (record_key, finding, field_name): keys that one copy lacks and fields whose values differ.

    Only the row with the latest ``version`` of a key counts on each side; if several share it, the
    one with the greatest hash of its compared values, so that the choice doesn't depend on order. A
    null version is the earliest. Null parts of a key count as ''. Keys and texts match without case
    and surrounding blanks; all ways of writing 'no value' (null, NaN, '', 'N/A', ...) are equal to
    each other and differ from any value. Columns that are neither key, field nor version are
    ignored. An empty side lacks every key of the other.
    """
    sides = [_canonical(df, key, fields, version) for df in (primary, mirror)]
    rows = max(1, primary.count(), mirror.count())
    buckets = 1 << max(0, (rows // bucket_rows).bit_length())
    slim = [df.select(F.lit(s).alias("side"), F.xxhash64("record").alias("k1"), F.xxhash64(F.lit("second"), "record").alias("k2"), "version", "element") for s, df in enumerate(sides)]
    latest = slim[0].unionAll(slim[1]).groupBy("side", "k1", "k2").agg(F.max(F.struct("version", "element")).alias("last"))
    elements = materialize(latest.groupBy("side", F.pmod("k1", F.lit(buckets)).alias("bucket")).agg(F.collect_list("last.element").alias("elements")), "elements")
    found = differing_elements(elements)
    recovered = found[0]
    for more in found[1:]:
        recovered = recovered.unionAll(more)
    small = recovered.count() <= BROADCAST_HASHES
    fetched = []
    for s, df in enumerate(sides):
        wanted = recovered.where(F.col("side") == s).select("element")
        own = df.join(F.broadcast(wanted) if small else wanted, "element", "left_semi")
        values = [c for c in own.columns if "__" in c]
        fetched.append(own.groupBy("record").agg(*(F.first(c).alias(c) for c in values)).select("record", F.struct(*values).alias(f"v{s}")))
    both = fetched[0].join(fetched[1], "record", "full_outer")
    differs = []
    for f in fields:
        a, b = F.col(f"v0.{f.name}__t"), F.col(f"v1.{f.name}__t")
        unequal = ~a.eqNullSafe(b)
        if f.kind == "number":
            x, y = F.col(f"v0.{f.name}__n"), F.col(f"v1.{f.name}__n")
            # The slack is for doubles whose decimal forms lie exactly the tolerance apart.
            unequal = F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) > f.tolerance * (1 + 1e-6)).otherwise(unequal | x.isNotNull() | y.isNotNull())
        differs.append(F.when(unequal, F.struct(F.lit("differs").alias("finding"), F.lit(f.name).alias("field_name"))))
    lone = lambda name: F.array(F.struct(F.lit(name).alias("finding"), F.lit("").alias("field_name")))
    cases = F.when(F.col("v1").isNull(), lone("missing_in_mirror")).when(F.col("v0").isNull(), lone("missing_in_primary")).otherwise(F.array_compact(F.array(*differs)))
    return both.select(_spelled(key).alias("record_key"), F.explode(cases).alias("case")).select("record_key", "case.finding", "case.field_name")


SCORE_KEY = [Key("target_id"), Key("seed_id", "lower"), Key("ligand_id"), Key("receptor_id", "tail_lower")]
SCORE_FIELDS = [Field("gpu_score", "number"), Field("status"), Field("scored_at", "time")]
RECEPTOR_KEY = [Key("conformer_id", "tail_lower")]
RECEPTOR_FIELDS = [
    Field("receptor_pdbqt_sha256", "hex"), Field("chain"), Field("residue_count", "number"), Field("receptor_atom_count", "number"), Field("hydrogen_like_atom_count", "number"),
    Field("charge_min", "number"), Field("charge_max", "number"), Field("status"), Field("validation_role"),
]


def copies_differ(scores: DataFrame, scores_mirror: DataFrame, receptors: DataFrame, receptors_mirror: DataFrame) -> DataFrame:
    """Rows (dataset, record_key, finding, field_name) for score rows and the receptor manifest."""
    s = reconcile(scores, scores_mirror, SCORE_KEY, SCORE_FIELDS, "loaded_at")
    r = reconcile(receptors, receptors_mirror, RECEPTOR_KEY, RECEPTOR_FIELDS, "loaded_at")
    return s.select(F.lit("scores").alias("dataset"), "*").unionAll(r.select(F.lit("receptors").alias("dataset"), "*"))
