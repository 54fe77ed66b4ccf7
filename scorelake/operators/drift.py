"""Schemas that drift between files: path-value rows, changes from file to file, one typed table.

Files are loaded as path-value rows with their raw types; arrays are values and aren't entered. A
file is compared with the one before it in its lineage by a join of the path rows on (lineage,
number, path), so a lineage of any length is spread over all tasks; what differs between two files
is bounded by the size of those files. Statistics of paths and types by file give each path its
column type, and values that can't be cast to it are reported, never dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions import json_text
from scorelake.operators.prefix import carried_values, running_total
from scorelake.storage import materialize

MARKS = "\ufeff\u200b \t\r\n"
_NODE = pa.struct([("path", pa.string()), ("type", pa.string()), ("value", pa.string())])


def _type(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return {str: "text", list: "array", dict: "object"}[type(value)]


def path_values(content: str | None) -> list[dict] | None:
    """Every path of a JSON object of any depth with its type and canonical value; None if the text is no JSON object.

    An object's value is a hash of its members' values, so each text is written once however deep
    it lies. Where keys with dots give one path twice, the later one gets '#2' and so on.
    """
    try:
        root = json_text.parse((content or "").strip(MARKS))
    except ValueError:
        return None
    if not isinstance(root, dict):
        return None
    out, seen, parents = [], {}, []  # parents: index of the object around, -1 at the top
    stack = [("", -1, root)]
    while stack:
        path, holder, node = stack.pop()
        for key, value in node.items():
            key = key.encode("utf-8", "replace").decode()  # lone surrogates are no text
            own = f"{path}.{key}" if path else key
            seen[own] = again = seen.get(own, 0) + 1
            out.append({"path": own if again == 1 else f"{own}#{again}", "type": _type(value), "value": None if isinstance(value, dict) else json_text.canonical(value), "key": key})
            parents.append(holder)
            if isinstance(value, dict):
                stack.append((own, len(out) - 1, value))
    inside: dict[int, list[str]] = {}
    for at in range(len(out) - 1, -1, -1):  # members stand behind their object
        row = out[at]
        if row["type"] == "object":
            row["value"] = "{" + sha256("\n".join(sorted(inside.pop(at, []))).encode()).hexdigest()
        inside.setdefault(parents[at], []).append(f"{json_text.scalar(row.pop('key'))}:{row['value']}")
    return out


def _flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        nodes = [path_values(x) for x in b.column("content").to_pylist()]
        names = [n for n in b.schema.names if n != "content"]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(nodes, pa.list_(_NODE))], [*names, "nodes"])


def _below(path: str, tops: set[str]) -> bool:
    at = path.rfind(".")
    while at > 0:
        path = path[:at]
        if path in tops:
            return True
        at = path.rfind(".")
    return False


def _parent(path: str) -> str:
    return path.rpartition(".")[0]


def classify(gone: list[tuple[str, str, str]], new: list[tuple[str, str, str]], retyped: list[str]) -> list[tuple[str, str, str]]:
    """(change_kind, field_path, old_path) between two files; gone and new hold (path, type, value).

    What lies below a gone or new path is gone or new itself, so going down by depth each path only
    looks at the one right above it.
    """
    tops = set(retyped)
    out = [("retyped", p, "") for p in retyped if not _below(p, tops)]

    def outside(rows: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
        under, kept = set(tops), []
        for row in sorted(rows, key=lambda x: (x[0].count("."), x[0])):
            if _parent(row[0]) in under:
                under.add(row[0])
            else:
                kept.append(row)
        return kept

    gone, new = outside(gone), outside(new)
    by_value: dict[str, list[str]] = {}
    for path, kind, value in new:
        if kind != "null":
            by_value.setdefault(value, []).append(path)
    left, taken, moved = set(), set(), set()
    for path, _, value in gone:
        parent, _, name = path.rpartition(".")
        if parent in moved:
            moved.add(path)
            continue
        fits = [p for p in by_value.get(value, []) if p not in taken and not _below(p, taken)]
        if fits:
            best = min(fits, key=lambda p: (_parent(p) != parent, p.rpartition(".")[2] != name, p))
            left.add(path)
            moved.add(path)
            taken.add(best)
            out.append(("renamed", best, path))
    for kind, rows, matched in (("added", new, taken), ("removed", gone, left)):
        holders = {m[:i] for m in matched for i, c in enumerate(m) if c == "."}
        under = set(matched)  # and what a reported path holds
        for path, _, _ in rows:
            if path in matched:
                continue
            if _parent(path) in under:
                under.add(path)
            elif path not in holders:
                under.add(path)
                out.append((kind, path, ""))
    return out


_EVENT = pa.struct([("change_kind", pa.string()), ("field_path", pa.string()), ("old_path", pa.string())])


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        events = []
        for differences in b.column("differences").to_pylist():
            sets: dict[str, list] = {"gone": [], "new": [], "retyped": []}
            for x in differences:
                sets[x["what"]].append((x["path"], x["type"], x["value"]))
            found = classify(sets["gone"], sets["new"], sorted(x[0] for x in sets["retyped"]))
            events.append([{"change_kind": k, "field_path": p, "old_path": o} for k, p, o in found])
        yield pa.RecordBatch.from_arrays([b.column("lineage_id"), b.column("file_id"), pa.array(events, pa.list_(_EVENT))], ["lineage_id", "file_id", "events"])


def path_rows(files: DataFrame) -> DataFrame:
    """Stored rows (lineage_id, family, file_id, number, path, type, value).

    Of a file delivered repeatedly the last delivery (received_at, delivery_id) counts. ``number``
    counts the files of a lineage by written_at, then file_id; null times come first. Texts that
    hold no JSON object give one row with a null path and type 'unreadable', objects without members
    one of type 'empty'.
    """
    last = files.groupBy("lineage_id", "file_id").agg(F.max_by(F.struct("family", "written_at", "content"), F.struct("received_at", "delivery_id")).alias("last"))
    rows = last.select("lineage_id", "file_id", "last.*")
    slim = running_total(rows.select("lineage_id", "file_id", "written_at"), ["lineage_id"], ["written_at", "file_id"], None, "number").drop("written_at")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ("lineage_id", "file_id")]
    numbered = rows.alias("r").join(slim.alias("s"), same).select("r.lineage_id", "r.family", "r.file_id", "r.written_at", "s.number", "r.content")
    schema = "lineage_id string, family string, file_id long, written_at timestamp, number long, nodes array<struct<path:string,type:string,value:string>>"
    flat = numbered.mapInArrow(_flatten, schema)
    lone = lambda kind: F.array(F.struct(F.lit(None).cast("string").alias("path"), F.lit(kind).alias("type"), F.lit(None).cast("string").alias("value")))
    node = F.explode(F.when(F.col("nodes").isNull(), lone("unreadable")).when(F.size("nodes") == 0, lone("empty")).otherwise(F.col("nodes")))
    return materialize(flat.select("lineage_id", "family", "file_id", "written_at", "number", node.alias("node")).select("lineage_id", "family", "file_id", "written_at", "number", "node.*"), "paths")


def changes(paths: DataFrame) -> DataFrame:
    """Rows (lineage_id, file_id, change_kind, field_path, old_path) of ``path_rows``.

    A path's type is its last known one while its value is null; a path that was away starts anew.
    Equal values of several vanished and new paths are paired with preference for the same parent,
    then the same name, then by path; null values are no ground for a renaming. An unreadable file
    is left out, and the next one is compared with nothing. Only where a value comes back from null
    its last type is looked up, by carrying it along the few rows at which a path turns null.
    """
    good = paths.where(F.col("path").isNotNull())
    now = good.select("lineage_id", "number", "path", "type", "value").alias("n")
    before = good.select("lineage_id", (F.col("number") + 1).alias("number"), "path", "type", "value").alias("b")
    both = now.join(before, ["lineage_id", "number", "path"], "full_outer")
    n, b = F.col("n.type"), F.col("b.type")
    what = F.when(b.isNull(), "new").when(n.isNull(), "gone").when(n == b, None).when(n == "null", "nulled").when(b == "null", "back").otherwise("retyped")
    rows = both.select("lineage_id", "number", "path", what.alias("what"), F.coalesce(n, b).alias("type"), b.alias("was"), F.coalesce("n.value", "b.value").alias("value"))
    rows = materialize(rows.where(F.col("what").isNotNull()), "differing")
    mark = F.when(F.col("what") == "nulled", F.col("was")).when(F.col("what") == "new", "")
    turns = rows.where("what IN ('nulled', 'back') OR (what = 'new' AND type = 'null')").select("lineage_id", "path", "number", "what", "type", "value", mark.alias("mark"))
    back = carried_values(turns, ["lineage_id", "path"], ["number"], {"known": "mark"}).where("what = 'back' AND known <> '' AND known <> type")
    told = rows.where("what IN ('new', 'gone', 'retyped')").select("lineage_id", "number", F.struct("what", "path", "type", "value").alias("x"))
    told = told.unionAll(back.select("lineage_id", "number", F.struct(F.lit("retyped").alias("what"), "path", "type", "value").alias("x")))
    files = paths.where("type <> 'unreadable'").groupBy("lineage_id", "number").agg(F.first("file_id").alias("file_id"))
    later = files.join(files.select("lineage_id", (F.col("number") + 1).alias("number")), ["lineage_id", "number"], "left_semi")
    grouped = told.groupBy("lineage_id", "number").agg(F.collect_list("x").alias("differences")).join(later, ["lineage_id", "number"]).select("lineage_id", "file_id", "differences")
    events = grouped.mapInArrow(_classify, "lineage_id string, file_id long, events array<struct<change_kind:string,field_path:string,old_path:string>>")
    return events.select("lineage_id", "file_id", F.explode("events").alias("e")).select("lineage_id", "file_id", "e.*")


def path_statistics(paths: DataFrame) -> DataFrame:
    """Per family and path: files that hold it, by type, and by numbers with a fraction or from 2**53 on; types pre-aggregated by file."""
    count = lambda t: F.count_if(F.col("type") == t).alias(f"{t}_files")
    number, whole = F.col("type") == "number", F.col("value").rlike(_WHOLE)
    wide = number & whole & (F.abs(F.col("value").try_cast("double")) >= float(2**53))
    return (
        paths.where(F.col("path").isNotNull())
        .groupBy("family", "path")
        .agg(
            F.count("*").alias("files"), *(count(t) for t in ("text", "number", "boolean", "object", "array", "null")), F.count_if(number & ~whole).alias("fraction_files"), F.count_if(wide).alias("wide_files"),
            F.min("number").alias("first_number"), F.max("number").alias("last_number"),
        )
    )


#: Types of columns, in the order that decides at equal counts, with the column of ``typed_values`` that holds them.
_HELD = {"number": "number", "boolean": "flag", "text": "text", "array": "text", "integer": "integer"}
_WHOLE = r"^\s*[-+]?[0-9]+\s*$"


def column_types(statistics: DataFrame) -> DataFrame:
    """Per family and leaf path the type that most files use (number before boolean before text before array at equal counts).

    A path whose numbers are all whole and partly 2**53 or more is 'integer', which keeps 38 digits;
    other numbers are doubles.
    """
    order = F.greatest(*(F.struct(F.col(f"{t}_files").alias("n"), F.lit(-i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(_HELD) if t != "integer"))
    leaf = statistics.where(F.col("text_files") + F.col("number_files") + F.col("boolean_files") + F.col("array_files") > 0)
    exact = (order["t"] == "number") & (F.col("wide_files") > 0) & (F.col("fraction_files") == 0)
    return leaf.select("family", "path", F.when(exact, "integer").otherwise(order["t"]).alias("wanted"))


def typed_values(paths: DataFrame) -> DataFrame:
    """Leaf values cast to the column type of their path.

    Rows (lineage_id, family, file_id, path, own_path, wanted, raw_type, raw_value, number, integer,
    flag, text, failed): exactly one of the value columns is set unless the value is null or can't be
    cast; ``own_path`` is the path in the file, before ``unified_paths``. An array in a text column
    stays as JSON text, but counts as failed too, like a text in an array column. A whole number that
    a double can't hold exactly fails in a column of doubles, a fraction in a column of integers.
    """
    types = column_types(path_statistics(paths))
    own = F.col("v.own_path") if "own_path" in paths.columns else F.col("v.path").alias("own_path")
    leaf = paths.where(F.col("path").isNotNull() & (F.col("type") != "object"))
    joined = leaf.alias("v").join(types.alias("t"), F.col("v.family").eqNullSafe(F.col("t.family")) & (F.col("v.path") == F.col("t.path")))
    raw = F.when(F.col("v.type") == "text", F.get_json_object(F.concat(F.lit('{"a":'), F.col("v.value"), F.lit("}")), "$.a")).when(F.col("v.type") != "null", F.col("v.value"))
    rows = joined.select("v.lineage_id", "v.family", "v.file_id", "v.path", own, "t.wanted", F.col("v.type").alias("raw_type"), raw.alias("raw_value"))
    real, digits = F.col("raw_value").try_cast("double"), F.when(F.col("raw_value").rlike(_WHOLE), F.col("raw_value").try_cast("decimal(38,0)"))
    exact = ~F.col("raw_value").rlike(_WHOLE) | (F.abs(real) < float(2**53)) | F.coalesce(digits == real.try_cast("decimal(38,0)"), F.lit(False))
    value: dict[str, Column] = {"number": F.when(exact, real), "integer": digits, "flag": F.col("raw_value").try_cast("boolean"), "text": F.col("raw_value")}
    rows = rows.select("*", *(F.when(F.col("wanted").isin(*(t for t, h in _HELD.items() if h == held)), c).alias(held) for held, c in value.items()))
    nothing = F.coalesce(*(F.col(c).cast("string") for c in value)).isNull()
    other_shape = (F.col("raw_type") == "array") != (F.col("wanted") == "array")
    return rows.withColumn("failed", F.col("raw_value").isNotNull() & (nothing | other_shape))


def _names(pairs: list[tuple[str, str]], uses: dict[str, int]) -> dict[str, str]:
    """For each name of a group linked by renamings the one that most files use (ties: the smallest)."""
    group: dict[str, str] = {}

    def root(p: str) -> str:
        while group.setdefault(p, p) != p:
            group[p] = group[group[p]]
            p = group[p]
        return p

    for old, new in pairs:
        group[root(old)] = root(new)
    classes: dict[str, list[str]] = {}
    for p in group:
        classes.setdefault(root(p), []).append(p)
    return {p: min(own, key=lambda x: (-uses.get(x, 0), x)) for own in classes.values() for p in own}


def unify(path: str, names: dict[str, str]) -> str:
    """The path with every renamed part under its common name; each group of names is applied once, so names within one another end."""
    applied: set[str] = set()
    while True:
        at = len(path)
        while at > 0 and (names.get(path[:at], path[:at]) == path[:at] or names[path[:at]] in applied):
            at = path.rfind(".", 0, at)
        if at <= 0:
            return path
        applied.add(names[path[:at]])
        path = names[path[:at]] + path[at:]


def unified_paths(paths: DataFrame, events: DataFrame, most: int = 100_000) -> DataFrame:
    """``paths`` with renamed fields under one name: that of the group of names which most files use (ties: the smallest), and own_path, the name in the file.

    Names are grouped along the renamings in ``events``, chains of any length, and replaced at any
    level, so a renamed object takes its fields along. Names that stand side by side in some file
    keep their own, as merging them would lose a value. There may be any number of paths; different
    renamings are a matter of the schema, and more than ``most`` of them are an error.
    """
    pairs = events.where("change_kind = 'renamed'").select("old_path", "field_path").distinct()
    found = [(r.old_path, r.field_path) for r in pairs.limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} different renamings")
    renamed = paths.sparkSession.createDataFrame([(p,) for p in sorted({p for pair in found for p in pair})], "path string")
    used = paths.where(F.col("path").isNotNull()).groupBy("path").agg(F.count("*").alias("files")).join(F.broadcast(renamed), "path", "left_semi")
    names = _names(found, {r.path: r.files for r in used.collect()})  # at most two names a renaming

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([unify(p, names) for p in b.column("path").to_pylist()], pa.string())], ["path", "unified"])

    table = paths.where(F.col("path").isNotNull()).select("path").distinct().mapInArrow(run, "path string, unified string").where("path <> unified")
    named = materialize(paths.withColumnRenamed("path", "own_path").join(table.withColumnRenamed("path", "own_path"), "own_path", "left").withColumn("unified", F.coalesce("unified", "own_path")), "unified")
    leaves = named.where("type <> 'object'")
    clash = leaves.groupBy("lineage_id", "file_id", "unified").agg(F.countDistinct("own_path").alias("n")).where("n > 1").select("unified").distinct().withColumn("clash", F.lit(True))
    kept = named.join(clash, "unified", "left").withColumn("path", F.when(F.col("clash"), F.col("own_path")).otherwise(F.col("unified")))
    return kept.select(*paths.columns, "own_path")


def consistent_table(paths: DataFrame, max_columns: int = 2000) -> DataFrame:
    """One row per file, one typed column per leaf path of any family, named by its path with '/' for '.'.

    The number of columns is that of the different paths, not of the rows; if it exceeds
    ``max_columns`` an error says so. Paths that only differ in case are told apart by a suffix.
    Two families may give a path different types; the column then is text. The values of a file
    come together as one map, from which the columns are taken.
    """
    kinds = column_types(path_statistics(paths)).groupBy("path").agg(F.collect_set("wanted").alias("kinds")).orderBy("path").limit(max_columns + 1).collect()
    if len(kinds) > max_columns:
        raise ValueError(f"more than {max_columns} different paths")
    held = ["number", "integer", "flag", "text"]
    values = typed_values(paths).repartition("lineage_id", "file_id").groupBy("lineage_id", "file_id", "path").agg(F.max(F.struct(*held)).alias("v"))
    maps = values.groupBy("lineage_id", "file_id").agg(F.map_from_entries(F.collect_list(F.struct("path", "v"))).alias("values"))
    files = paths.select("lineage_id", "family", "file_id").distinct()
    seen, columns = {}, []
    for row in kinds:
        kind = row.kinds[0] if len(row.kinds) == 1 else "text"
        name = row.path.replace(".", "/")
        seen[name.lower()] = again = seen.get(name.lower(), 0) + 1
        value = F.col("values")[F.lit(row.path)]
        source = F.coalesce(*(value[h].cast("string") for h in reversed(held))) if kind == "text" else value[_HELD[kind]]
        columns.append(source.alias(name if again == 1 else f"{name}#{again}"))
    return files.join(maps, ["lineage_id", "file_id"], "left").select("lineage_id", "file_id", "family", *columns)
