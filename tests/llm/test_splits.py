from __future__ import annotations

import random

import pytest

from scorelake.llm import components, splits

SCHEMA = "ligand_id string, label string, split_group_id string, scaffold_smiles string, source_molecule_id string, document_id string, outer_fold int, record string, anchor string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "clash", "clash") for r in rows], SCHEMA)


def targets(spark, *shares):
    return spark.createDataFrame([(n, s) for n, s in zip(("train", "validation", "test"), shares)], "split_name string, target_share double")


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for u, v in edges:
        parent[find(u)] = find(v)
    out = {}
    for x in parent:
        out.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, out.values()))


def test_contraction(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(5000, 5200), rng.randrange(5000, 5200)) for _ in range(130)]
    edges = [(u, v) for u, v in edges if u != v]
    df = spark.createDataFrame(edges + edges[:50] + [(7, 7), (None, 3), (4, None)], "u long, v long")
    got = {}
    for r in components.contract(df).collect():
        got.setdefault(r.root, set()).add(r.vertex)
    assert sorted(map(sorted, got.values())) == union_find(edges)
    assert components.contract(df.limit(0)).count() == 0


def test_links(spark, rows):
    df = frame(
        spark,
        [
            ("b", "active", "G-1", None, None, None), (" B ", None, None, None, "S 9", None), ("A", "decoy", "g_1", None, "unknown", "N/A"), ("C", "0", " ", "CC ", "s:9", "-"), ("D", "decoy", None, "cc", None, ""),
            ("E", "decoy", None, "CC", None, None), ("F", "decoy", None, None, "Unknown", "n/a"), (None, "active", "g1", None, None, None),
        ],
    )
    assert rows(splits.linked_sets(df)) == [("A", "A"), ("B", "A"), ("C", "A"), ("E", "A")]
    assert splits.linked_sets(df.limit(0)).count() == 0


def test_shares_and_whole_sets(spark):
    rng = random.Random(1)
    recs = []
    for i in range(3000):
        group = "big" if i < 900 else f"g{rng.randrange(900)}"
        recs.append((f"L{i:05d}", "active" if rng.random() < 0.1 else "decoy", group, None, None, f"d{i}" if i % 3 else None))
    df = frame(spark, recs)
    got = splits.assign_splits(df, targets(spark, 0.6, 0.2, 0.2)).collect()
    assert len({r.ligand_id for r in got}) == len(got) == 3000
    by = {}
    for r in got:
        by.setdefault(r.anchor, set()).add(r.split_name)
    assert all(len(s) == 1 for s in by.values())
    report = {r.split_name: r for r in splits.split_report(splits.assign_splits(df, targets(spark, 0.6, 0.2, 0.2)), df).collect()}
    for name, share in (("train", 0.6), ("validation", 0.2), ("test", 0.2)):
        assert abs(report[name].record_share - share) < 0.02 and abs(report[name].active_share - share) < 0.05


def test_odd_targets_and_empty(spark):
    df = frame(spark, [("A", None, None, None, None, None), ("A", None, None, None, None, None)])
    assert splits.assign_splits(df, targets(spark)).count() == 0
    assert splits.assign_splits(df.limit(0), targets(spark, 0.6, 0.2, 0.2)).count() == 0
    got = splits.assign_splits(df, targets(spark, 3.0, None, -1.0)).collect()
    assert [(r.ligand_id, r.split_name) for r in got] == [("A", "train")]


def test_sets_on_both_sides_of_the_big_share(spark, monkeypatch):
    """Sets just above and just below the share at which they are placed by deficit stay whole, and sizes near the targets."""
    rows = [(f"L{i:05d}", None, f"g{i // 5}" if i < 1000 else f"h{i // 4}", None, None, None, None, "active" if i % 9 == 0 else "decoy") for i in range(2000)]
    df = spark.createDataFrame(rows, "ligand_id string, target_id string, split_group_id string, scaffold_smiles string, canonical_smiles string, source_molecule_id string, document_id string, label string")
    targets = spark.createDataFrame([("train", 0.6), ("validation", 0.2), ("test", 0.2)], "split_name string, target_share double")
    monkeypatch.setattr(splits, "BIG", 5 / 2000)
    got = splits.assign_splits(df, targets).collect()
    sets = {}
    for r in got:
        sets.setdefault(r.anchor, set()).add(r.split_name)
    sizes = {n: sum(r.split_name == n for r in got) / 2000 for n in ("train", "validation", "test")}
    assert len(got) == 2000 and all(len(x) == 1 for x in sets.values())
    assert sizes["train"] == pytest.approx(0.6, abs=0.02) and sizes["test"] == pytest.approx(0.2, abs=0.02)
