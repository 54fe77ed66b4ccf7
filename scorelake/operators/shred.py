"""Nested records as flat tables: objects stored once, every occurrence kept.

Each object of a record gets an identity bottom-up: the hash of its own values and of the identities
of its parts. Identical objects share one row of the object table; each place where one stands is a
row of the occurrence table with its parent's identity, the field and its position. Objects and
arrays held as JSON text count like others. Records are shredded where they lie; only hashes and
paths are shuffled.

An object's own values keep all that isn't an object: an array that holds objects keeps its other
elements, with ``{"#": n}`` in the place of the n-th object below the owner, and so does a field that
is an object. With the bridge rows, sorted by path, a record can be rebuilt (``rebuild``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions import json_text
from scorelake.functions.text import BLANKS
from scorelake.storage import materialize

MARKS = "﻿​ \t\r\n"
_NODE = "array<struct<node_path:string,parent_path:string,owner_path:string,field:string,ordinal:int,place:int,object_hash:string,owner_hash:string,own_values:string>>"
_FIELDS = ("node_path", "parent_path", "owner_path", "field", "ordinal", "place", "object_hash", "owner_hash", "own_values")


def _opened(value: object) -> object:
    """The object or array that a text holds, else the value itself."""
    while isinstance(value, str):
        text = value.strip(MARKS)
        if text[:1] + text[-1:] not in ("{}", "[]"):
            return value
        try:
            value = json_text.parse(text)
        except ValueError:
            return value
    return value


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:32]


class _Open:
    """An array or object whose parts are being read."""

    __slots__ = ("value", "path", "element", "owner", "field", "ordinal", "place", "keys", "at", "identity", "own", "below")

    def __init__(self, value, path, element, owner, field, ordinal, place):
        self.value, self.path, self.element, self.owner, self.field, self.ordinal, self.place = value, path, element, owner, field, ordinal, place
        self.keys = iter(sorted(value)) if isinstance(value, dict) else iter(range(len(value)))
        self.at: str | int | None = None  # key of the part being read
        self.identity: list[str] = []
        self.own: dict | list = {} if isinstance(value, dict) else []
        self.below: list[dict] = []  # of an object: the rows of the objects right below it


def shred_record(text: str | None) -> list[dict]:
    """One row per object of a record of any depth, parts before wholes.

    A record that is an array gives a row for it as well; a text that is no JSON object or array is
    kept as one row whose field is 'unreadable'; blank texts give none.
    """
    plain = (text or "").strip(MARKS)
    root, out = _opened(plain), []
    if not isinstance(root, (dict, list)):
        return [dict(zip(_FIELDS, ("", "", "", "unreadable", None, 0, _digest(plain), None, json_text.scalar(plain))))] if plain else []
    top = _Open(root, "", "", "", "", None, 0)
    stack, holders = [top], [top]  # holders: the objects around, innermost last
    while True:
        top = stack[-1]
        top.at = next(top.keys, None)
        if top.at is not None:
            named = isinstance(top.value, dict)
            part = _opened(top.value[top.at])
            if isinstance(part, (dict, list)):
                name = top.at.encode("utf-8", "replace").decode() if named else ""  # lone surrogates are no text
                path = (f"{top.path}.{name}" if top.path else name) if named else f"{top.path}[{top.at}]"
                holder = holders[-1]
                stack.append(_Open(part, path, top.element if named else path, holder.path, name if named else top.field, None if named else top.at, len(holder.below)))
                if isinstance(part, dict):
                    holders.append(stack[-1])
                continue
            identity, kept = _digest("=" + json_text.scalar(part)), part
        else:
            stack.pop()
            named = isinstance(top.value, dict)
            identity = _digest(("{" if named else "[") + ",".join(top.identity))
            kept = top.own
            if top is holders[-1]:
                holders.pop()
                node = dict(zip(_FIELDS, (top.path, top.element, top.owner, top.field, top.ordinal, top.place, identity, None, json_text.canonical(top.own))))
                for x in top.below:
                    x["owner_hash"] = identity
                out.append(node)
                if holders:
                    holders[-1].below.append(node)
                    kept = {"#": top.place}
            if not stack:
                return out
            top = stack[-1]
        if isinstance(top.value, dict):
            top.identity.append(json_text.scalar(top.at) + identity)
            top.own[top.at] = kept
        else:
            top.identity.append(identity)
            top.own.append(kept)


def rebuild(nodes: list[dict]) -> object:
    """The record that ``nodes`` (rows of one record: node_path, owner_path, place, own_values) came from, with JSON texts opened."""
    own = {n["node_path"]: json_text.parse(n["own_values"]) for n in nodes}
    at = {(n["owner_path"], n["place"]): n["node_path"] for n in nodes if n["node_path"]}
    for path, values in own.items():
        todo = [values]
        while todo:
            holder = todo.pop()
            for key in holder if isinstance(holder, dict) else range(len(holder)) if isinstance(holder, list) else ():
                part = holder[key]
                if isinstance(part, dict):
                    holder[key] = own[at[path, part["#"]]]
                elif isinstance(part, list):
                    todo.append(part)
    return own[""]


def shred(records: DataFrame, record_id: str = "record_id", record: str = "record") -> DataFrame:
    """Stored rows (record_id, node_path, parent_path, owner_path, field, ordinal, place, object_hash, owner_hash, own_values).

    ``parent_path``: the innermost array element that is or contains the object; ``owner_path``: the
    object around it; ``place``: the how-manieth object of its owner it is, in the order of sorted
    keys; ``own_values``: its values without the objects below it, as JSON. Blank and null records
    give no row, unreadable ones their text. A record that comes twice gives its rows twice here; the
    tables below count it once.
    """
    integers = ("ordinal", "place")
    node = pa.list_(pa.struct([(f, pa.int32() if f in integers else pa.string()) for f in _FIELDS]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("record_id"), pa.array([shred_record(x) for x in b.column("record").to_pylist()], node)], ["record_id", "nodes"])

    slim = records.select(F.col(record_id).cast("long").alias("record_id"), F.col(record).cast("string").alias("record"))
    return materialize(slim.mapInArrow(run, f"record_id long, nodes {_NODE}").select("record_id", F.explode("nodes").alias("n")).select("record_id", "n.*"), "nodes")


def object_table(nodes: DataFrame) -> DataFrame:
    """Each different object once: (object_hash, own_values, occurrences)."""
    once = nodes.select("record_id", "node_path", "object_hash", "own_values").groupBy("record_id", "node_path", "object_hash").agg(F.first("own_values").alias("own_values"))
    return once.groupBy("object_hash").agg(F.first("own_values").alias("own_values"), F.count("*").alias("occurrences"))


def occurrence_table(nodes: DataFrame) -> DataFrame:
    """Bridge rows: every place of every object, with its owner and position; a repeated record counts once."""
    return nodes.select("record_id", "node_path", "parent_path", "owner_path", "field", "ordinal", "place", "object_hash", "owner_hash").distinct()


def hashed_objects(nodes: DataFrame, field: str = "sha256") -> DataFrame:
    """Rows (record_id, node_path, parent_path) of objects with a non-blank text in ``field``."""
    at = f"$['{field}']"
    value = F.try_variant_get(F.try_parse_json("own_values"), at, "variant")
    text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
    with_field = nodes.groupBy("object_hash").agg(F.first("own_values").alias("own_values")).where(F.length(F.btrim(text, F.lit(BLANKS))) > 0)
    return occurrence_table(nodes).join(with_field.select("object_hash"), "object_hash", "left_semi").select("record_id", "node_path", "parent_path")


def _kind() -> Column:
    return F.regexp_replace("node_path", r"\[\d+\]", "")


def entity_kinds(nodes: DataFrame) -> DataFrame:
    """Each kind of place (path without positions) with its occurrences, records and different objects; the flat tables that ``entity_table`` gives."""
    once = nodes.select("record_id", "node_path", "object_hash").distinct()
    return once.groupBy(_kind().alias("kind")).agg(F.count("*").alias("occurrences"), F.countDistinct("record_id").alias("records"), F.countDistinct("object_hash").alias("objects"))


def entity_table(nodes: DataFrame, kind: str, most: int = 2000) -> DataFrame:
    """The flat table of the objects at one kind of place, such as ``receptors.seeds.pose`` (positions left out).

    One row per occurrence with its keys (record_id, node_path, parent_path, owner_path, ordinal,
    object_hash, owner_hash) and a column ``_<field>`` per field that any of them has, as text (arrays
    as JSON, fields that are objects as their place); more than ``most`` fields are an error.
    """
    keys = ["record_id", "node_path", "parent_path", "owner_path", "ordinal", "object_hash", "owner_hash"]
    values = F.from_json("own_values", "map<string,string>")
    rows = nodes.where(_kind() == kind).select(*keys, values.alias("own")).dropDuplicates(["record_id", "node_path", "object_hash"])
    fields = sorted(r[0] for r in rows.select(F.explode(F.map_keys("own"))).distinct().limit(most + 1).collect())
    if len(fields) > most:
        raise ValueError(f"more than {most} fields")
    return rows.select(*keys, *(F.col("own")[F.lit(f)].alias(f"_{f}") for f in fields))
