from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from scorelake.operators import drift

T = [dt.datetime(2025, 1, d) for d in range(1, 15)]
SCHEMA = "delivery_id long, file_id long, lineage_id string, family string, written_at timestamp, received_at timestamp, content string, number string, path string"


def files(spark, contents, lineage="L"):
    rows = [(i, i, lineage, "f", T[i], T[i], c if isinstance(c, str) or c is None else json.dumps(c), "n", "p") for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, SCHEMA)


def events(spark, contents):
    got = drift.changes(drift.path_rows(files(spark, contents))).collect()
    return sorted((r.file_id, r.change_kind, r.field_path, r.old_path) for r in got)


def test_kinds(spark):
    got = events(
        spark,
        [
            {"a": 1, "b": {"x": "t", "y": 2}, "c": "keep"},
            {"a": 1.5, "bb": {"y": 2, "x": "t"}, "c": None},
            {"a": "1.5", "bb": {"x": {"deep": 1}, "y": 2}, "c": 5, "new": {"p": 1, "q": None}},
            {"a": "1.5", "bb": {"x": {"deep": 1}, "y": 2}, "c": 5, "new": {"p": 1}, "meta": {"inner": "moved"}},
            {"a": "1.5", "bb": {"x": {"deep": 1}, "y": 2}, "c": 5, "new": {"p": 1}, "inner": "moved"},
        ],
    )
    assert got == [(1, "renamed", "bb", "b"), (2, "added", "new", ""), (2, "retyped", "a", ""), (2, "retyped", "bb.x", ""), (2, "retyped", "c", ""), (3, "added", "meta", ""), (3, "removed", "new.q", ""), (4, "renamed", "inner", "meta.inner")]


def test_object_new_only_for_renamed_fields(spark):
    assert events(spark, [{"id": "v", "n": 1}, {"wrap": {"id": "v"}, "n": 1}]) == [(1, "renamed", "wrap.id", "id")]


def test_unreadable_repeated_and_empty(spark):
    assert events(spark, [{"a": 1}, "no json", None, "", {"b": 1}]) == []
    rows = files(spark, [{"a": 1}, {"b": 1}])
    again = rows.unionAll(rows.where("file_id = 1"))
    assert drift.changes(drift.path_rows(again)).count() == 1
    assert drift.changes(drift.path_rows(rows.limit(0))).count() == 0
    assert drift.consistent_table(drift.path_rows(rows.limit(0))).count() == 0


def test_table_and_failed_casts(spark):
    paths = drift.path_rows(files(spark, [{"v": 1, "w": True}, {"v": 2.5}, {"v": "x"}, "﻿" + json.dumps({"v": "3", "W": [1, 2]}), {"v": "z" * 50000}]))
    stats = {r.path: r for r in drift.path_statistics(paths).collect()}
    assert (stats["v"].number_files, stats["v"].text_files) == (2, 3)
    wide = drift.consistent_table(paths)
    assert wide.count() == 5 and len({c.lower() for c in wide.columns}) == len(wide.columns)
    small = drift.path_rows(files(spark, [{"v": 1}, {"v": 2.5}, {"v": "x"}, {"v": "3"}, {"v": 4}]))
    failed = drift.typed_values(small).where("failed").select("file_id", "raw_value").collect()
    assert [(r.file_id, r.raw_value) for r in failed] == [(2, "x")]
    assert sorted(r.v for r in drift.consistent_table(small).collect() if r.v is not None) == [1.0, 2.5, 3.0, 4.0]


def test_renamed_fields_share_a_column(spark):
    paths = drift.path_rows(files(spark, [{"gate": {"chain": "A"}, "id": 1, "x": 5}, {"preflight": {"chain": "A"}, "meta": {"id": 1}, "x": 5}, {"preflight": {"chain": "B"}, "run": 1, "x": 5}, {"preflight": {"chain": "B"}, "run": 2, "y": 5}, {"preflight": {"chain": "B"}, "run": 3, "x": 6, "y": 7}]))
    wide = drift.consistent_table(drift.unified_paths(paths, drift.changes(paths)))
    assert set(wide.columns) == {"lineage_id", "file_id", "family", "preflight/chain", "run", "x", "y"}
    rows = {r.file_id: r for r in wide.collect()}
    assert [rows[i]["preflight/chain"] for i in range(5)] == ["A", "A", "B", "B", "B"] and [rows[i].run for i in range(5)] == [1, 1, 1, 2, 3]
    assert [(rows[i].x, rows[i].y) for i in (3, 4)] == [(None, 5.0), (6.0, 7.0)]  # side by side in the last file


def test_any_depth_and_many_paths(spark):
    deep = lambda leaf: '{"a":' * 1500 + leaf + "}" * 1500
    got = events(spark, [deep("1"), deep('"x"'), '{"b": 1}'])
    assert [(k, p.count("."), o) for _, k, p, o in got] == [("retyped", 1499, ""), ("added", 0, ""), ("removed", 0, "")]
    assert drift.path_values('{"a":' * 5000 + "[[1]]" + "}" * 5000)[-1]["path"].count("a") == 5000
    assert drift.path_values('{"a":' + "[" * 20000 + "]" * 20000 + "}")[0]["type"] == "array"
    names = {f"p{i}": i for i in range(50_000)}
    paths = drift.path_rows(files(spark, [{"old": "moved", **names}, {"p": {"new": "moved"}, **names}]))
    moved = drift.unified_paths(paths, drift.changes(paths)).where("own_path <> path").collect()
    assert [(r.own_path, r.path) for r in moved] == [("p.new", "old")]


def test_chain_of_renamings(spark):
    rows = [{f"n{i:02d}": {"deep": "value", "k": 1}, "x": i} for i in range(21)]
    paths = drift.path_rows(files(spark, [r for r in rows[:14]]))
    wide = drift.consistent_table(drift.unified_paths(paths, drift.changes(paths)))
    assert set(wide.columns) == {"lineage_id", "file_id", "family", "n00/deep", "n00/k", "x"}
    assert all(r["n00/deep"] == "value" for r in wide.collect())
    names = drift._names([(f"n{i}", f"n{i + 1}") for i in range(20)], {"n20": 2})
    assert {drift.unify(f"n{i}.q", names) for i in range(21)} == {"n20.q"}
    assert drift.unify("a.x", drift._names([("a", "a.b")], {"a.b": 5})) == "a.b.x"


def test_types_over_nulls_and_gaps(spark):
    got = events(spark, [{"a": 1}, {"a": None}, {"a": None}, {"a": "t"}, {}, {"a": None}, {"a": 5}, {"a": None}, {"a": 6}])
    assert got == [(3, "retyped", "a", ""), (4, "removed", "a", ""), (5, "added", "a", "")]


def test_long_integers_are_kept_or_reported(spark):
    big = 9007199254740993
    exact = drift.path_rows(files(spark, [{"v": big}, {"v": 1}, {"v": "2.5"}]))
    assert sorted(int(r.v) for r in drift.consistent_table(exact).collect() if r.v is not None) == [1, big]
    assert [r.raw_value for r in drift.typed_values(exact).where("failed").collect()] == ["2.5"]
    mixed = drift.path_rows(files(spark, [{"v": big}, {"v": 1.5}, {"v": 2}]))
    assert [r.raw_value for r in drift.typed_values(mixed).where("failed").collect()] == [str(big)]


def test_every_value_is_in_the_table_or_reported(spark, folder):
    from scorelake.plans import training

    paths = training._unified(spark, folder)
    typed = drift.typed_values(paths)
    assert typed.where("raw_type <> 'null'").count() == paths.where("path IS NOT NULL AND type NOT IN ('object', 'null')").count()
    lost = typed.where("raw_value IS NOT NULL AND NOT failed AND coalesce(cast(number AS string), cast(integer AS string), cast(flag AS string), text) IS NULL")
    assert lost.count() == 0
    wide = training.p2_table(spark, folder)
    assert wide.count() == paths.select("lineage_id", "file_id").distinct().count()
    cells = wide.select(F.expr("+".join(f"int(`{c}` IS NOT NULL)" for c in wide.columns[3:])).alias("n")).agg(F.sum("n")).first()[0]
    kept = typed.where("coalesce(cast(number AS string), cast(integer AS string), cast(flag AS string), text) IS NOT NULL").select("lineage_id", "file_id", "path").distinct().count()
    assert cells == kept
