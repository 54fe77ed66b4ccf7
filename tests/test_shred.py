from __future__ import annotations

import json
import random

from scorelake.operators import shred

SCHEMA = "record_id long, record string, node_path string, nodes int"


def frame(spark, records):
    rows = [(i, r if isinstance(r, str) or r is None else json.dumps(r), "clash", 1) for i, r in records]
    return spark.createDataFrame(rows, SCHEMA)


def brute(i, value, path="", element=""):
    while isinstance(value, str) and value.strip()[:1] in ("{", "["):
        try:
            value = json.loads(value)
        except ValueError:
            break
    if isinstance(value, dict):
        if isinstance(value.get("sha256"), str) and value["sha256"].strip():
            yield i, path, element
        for k, v in value.items():
            yield from brute(i, v, f"{path}.{k}" if path else k, element)
    elif isinstance(value, list):
        for n, v in enumerate(value):
            yield from brute(i, v, f"{path}[{n}]", f"{path}[{n}]")


def build(rng, depth=0):
    kind = rng.choice("oooaasntb" if depth < 4 else "snt")
    if kind == "o":
        out = {k: build(rng, depth + 1) for k in rng.sample("abcdef", rng.randint(0, 4))}
        if rng.random() < 0.5:
            out["sha256"] = rng.choice(["ab12", " ", "", None, 7, "ff"])
        return json.dumps(out) if rng.random() < 0.15 else out
    if kind == "a":
        return [build(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {"s": "text", "n": 3.5, "t": None, "b": True}[kind]


def test_against_brute_force(spark):
    rng = random.Random(4)
    records = [(i, {"r": build(rng), "sha256": "root"}) for i in range(60)]
    got = {tuple(r) for r in shred.hashed_objects(shred.shred(frame(spark, records))).collect()}
    assert got == {x for i, r in records for x in brute(i, r)}


def test_identities_and_bridges(spark):
    same = {"path": "p", "sha256": "aa"}
    nodes = shred.shred(frame(spark, [(1, {"x": same, "y": [same, {"z": same}]}), (2, {"x": {"sha256": "aa", "path": "p"}}), (2, {"x": {"sha256": "aa", "path": "p"}})]))
    objects = shred.object_table(nodes).collect()
    assert sorted(r.occurrences for r in objects) == [1, 1, 1, 4]
    links = {(r.record_id, r.node_path): r for r in shred.occurrence_table(nodes).collect()}
    assert links[1, "y[1].z"].parent_path == "y[1]" and links[1, "y[1].z"].owner_path == "y[1]" and links[1, "y[0]"].ordinal == 0
    assert links[1, "y[0]"].owner_hash == links[1, ""].object_hash
    assert shred.entity_table(nodes, "y.z").count() == 1


def opened(value):
    """The record with JSON texts opened, numbers as the tables hold them."""
    while isinstance(value, str) and value.strip()[:1] in ("{", "["):
        try:
            value = json.loads(value, parse_constant=str)
        except ValueError:
            break
    if isinstance(value, dict):
        return {k: opened(v) for k, v in value.items()}
    return [opened(v) for v in value] if isinstance(value, list) else value


def test_every_record_can_be_rebuilt(spark, folder):
    records = spark.read.parquet(f"{folder}/run_records.parquet")
    nodes = {}
    for r in shred.shred(records).collect():
        nodes.setdefault(r.record_id, []).append(r.asDict())
    texts = {r.record_id: r.record for r in records.collect() if (r.record or "").strip(shred.MARKS)}
    assert nodes.keys() == texts.keys()
    for i, text in texts.items():
        assert shred.rebuild(nodes[i]) == opened(text.strip(shred.MARKS))


def test_mixed_arrays_and_any_depth(spark):
    mixed = {"a": [1, {"sha256": "x"}, "kept", [None, {"b": {}}, True]], "c": {"d": [[], {}]}}
    assert shred.rebuild(shred.shred_record(json.dumps(mixed))) == mixed
    assert shred.rebuild(shred.shred_record(json.dumps([1, mixed, "x"]))) == [1, mixed, "x"]
    rng = random.Random(6)
    for _ in range(200):
        value = {"r": build(rng)}
        assert shred.rebuild(shred.shred_record(json.dumps(value))) == opened(value)
    rows = shred.shred_record('{"a":[' * 2500 + '{"sha256": "deep"}' + "]}" * 2500)
    assert len(rows) == 2501 and rows[0]["node_path"].count("a[0]") == 2500 and rows[-1]["node_path"] == ""
    got = shred.hashed_objects(shred.shred(frame(spark, [(1, '{"a":' * 3000 + '{"sha256": "deep"}' + "}" * 3000)]))).collect()
    assert len(got) == 1 and got[0].node_path.count("a") == 3000
    kept = shred.shred_record("{broken")
    assert [(r["field"], r["own_values"]) for r in kept] == [("unreadable", '"{broken"')]


def test_entity_tables(spark, folder):
    nodes = shred.shred(spark.read.parquet(f"{folder}/run_records.parquet"))
    kinds = {r.kind: r.occurrences for r in shred.entity_kinds(nodes).collect()}
    for kind in sorted(kinds)[:6]:
        assert shred.entity_table(nodes, kind).count() == kinds[kind]


def test_odd_records(spark):
    odd = [(1, None), (2, ""), (3, "  "), (4, "{broken"), (5, "[]"), (6, '{"a": NaN, "sha256": "x"}'), (None, '{"sha256": "n"}'), (8, "[" * 100000), (9, json.dumps({"a": "y" * 200000, "sha256": "long"})), (10, '{"\\ud800": {"sha256": "s"}}')]
    got = {(r.record_id, r.node_path) for r in shred.hashed_objects(shred.shred(frame(spark, odd))).collect()}
    assert got == {(6, ""), (None, ""), (9, ""), (10, "?")}
    assert shred.hashed_objects(shred.shred(frame(spark, odd).limit(0))).count() == 0
