"""Queries without a SQL counterpart, against brute force over whole tables."""

from __future__ import annotations

from itertools import combinations
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from scorelake.plans import base


@pytest.fixture(scope="module")
def db(folder):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def test_greedy_over_all_receptors(spark, folder):
    value, pair = {}, {}
    for r in entry.queries()["coefficient_table"](spark, folder).collect():
        if r.b:
            pair[r.target_id, r.a, r.b] = r.value
        else:
            value.setdefault(r.target_id, {})[r.a] = r.value
    want = set()
    for t, gaps in value.items():
        chosen = []
        for step in range(1, min(3, len(gaps)) + 1):
            gain = {x: g - 0.5 * sum(pair.get((t, *sorted((x, c))), 0) for c in chosen) for x, g in gaps.items() if x not in chosen}
            chosen.append(min(gain, key=lambda x: (-round(gain[x], 9), x)))
            want.add((t, step, chosen[-1]))
    assert max(len(g) for g in value.values()) > 6
    assert {(r.target_id, r.step, r.receptor_id) for r in entry.queries()["greedy_subset"](spark, folder).collect()} == want
    subsets = entry.queries()["exact_subset"](spark, folder).collect()
    assert {r.target_id: r.states for r in subsets} == {t: sum(1 for _ in combinations(g, 3)) for t, g in value.items() if len(g) > 2}


def test_maxmin_for_every_request(spark, folder, db):
    near = db.execute(f"SELECT pool_id, a, b, distance FROM ({base.SQL['clean_pairs']}) JOIN ({base.CTES['members']}) ON id = a UNION ALL SELECT pool_id, b, a, distance FROM ({base.SQL['clean_pairs']}) JOIN ({base.CTES['members']}) ON id = b").fetchall()
    pools, want = {}, set()
    for pool, a, b, x in near:
        pools.setdefault(pool, {}).setdefault(a, {})[b] = x
    most = db.execute("SELECT max(subset_size) FROM selection_requests").fetchone()[0]
    for pool, rows in pools.items():
        chosen = [min(rows)]
        while len(chosen) < most and (far := {a: min(b[c] for c in chosen if c in b) for a, b in rows.items() if a not in chosen and any(c in b for c in chosen)}):
            chosen.append(min(far, key=lambda a: (-far[a], a)))
        want |= {(pool, k, a) for k, a in enumerate(chosen, 1)}
    got = {(r.pool_id, r.step, r.id) for r in entry.queries()["maxmin_conformers"](spark, folder).collect()}
    assert got == want and max(k for _, k, _ in got) > 3


def test_short_scaffolds_link(spark, tmp_path):
    rows = [("a", "g1", "c1ccccc1"), ("b", "g2", "c1ccccc1"), ("c", "g3", "Unspecified"), ("d", "g4", "Unspecified"), ("e", "g5", " N/A "), ("f", "g6", None), ("g", "g7", "C1CC1"), ("h", "g7", "N/A")]
    spark.createDataFrame(rows, "ligand_id string, split_group_id string, scaffold_smiles string").write.parquet(str(tmp_path / "ligands.parquet"))
    got = {r.ligand_id: r.group_key for r in entry.queries()["scaffold_groups"](spark, str(tmp_path)).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e", "f": "f", "g": "g", "h": "g"}
