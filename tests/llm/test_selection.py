from __future__ import annotations

import random

import numpy as np

from scorelake.llm import selection

SCHEMA = "conformer_id string, target_id string, pool_id string, source_type string, status string, resolution_angstrom double, pocket_features array<double>, features string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(c, "T", p, s, st, r, f, "clash", 1) for c, p, s, st, r, f in rows], SCHEMA)


def shapes(rng, pool, count, kinds, dims=5):
    centres = [[rng.uniform(-5, 5) for _ in range(dims)] for _ in range(kinds)]
    out = []
    for i in range(count):
        k = 0 if rng.random() < 0.6 else rng.randrange(kinds)
        out.append((f"{pool}_{i:04d}", pool, rng.choice(["crystal", "md", None]), rng.choice(["eligible", "reserve"]), rng.choice([None, 1.5, 2.5]), [x + rng.gauss(0, 0.3) for x in centres[k]]))
    return out


def brute(rows):
    pools, out = {}, set()
    for c, p, _, _, _, f in rows:
        if f:
            pools.setdefault(p, {})[c] = f
    for own in pools.values():
        ids = sorted(own)
        m = np.array([own[i] for i in ids])
        sd = m.std(0)
        z = (m - m.mean(0)) / np.where(sd > 0, sd, 1)
        for i in range(len(ids)):
            for j in range(i + 1, len(ids)):
                if round(float(np.sqrt(((z[i] - z[j]) ** 2).sum())), 6) <= 1:
                    out.add((ids[i], ids[j]))
    return out


def test_pairs_against_brute_force(spark):
    rng = random.Random(8)
    rows = shapes(rng, "p1", 150, 12) + shapes(rng, "p2", 40, 40) + shapes(rng, "p3", 1, 1)
    rows += [("none", "p1", "md", "incomplete", None, None), ("nan", "p1", "md", "x", None, [float("nan")] * 5), ("lost", None, "md", "x", None, [0.0] * 5)] + rows[:20]
    got = selection.near_pairs(selection.standardized(frame(spark, rows)))
    pairs = [(r.conformer_id_a, r.conformer_id_b) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute([r for r in rows if r[1] and r[5] and r[5][0] == r[5][0]])
    assert selection.near_pairs(selection.standardized(frame(spark, rows).limit(0))).count() == 0


def test_blocks_of_a_hot_combination(spark, monkeypatch):
    monkeypatch.setattr(selection, "BLOCK", 7)
    rows = [(f"c{i:03d}", "p", "md", "eligible", None, [1.0, 2.0, 3.0, i % 2 * 50.0]) for i in range(60)]
    assert selection.near_pairs(selection.standardized(frame(spark, rows))).count() == 2 * 30 * 29 // 2


def test_flow():
    counts = {("a", "x"): 50, ("a", "y"): 50, ("b", "x"): 1, ("c", "y"): 1, ("d", "x"): 1}
    quotas = selection.flow_quotas(counts, 4)
    assert sum(quotas.values()) == 4 and {s for s, _ in quotas} == {"a", "b", "c", "d"}
    assert sum(n for (_, t), n in quotas.items() if t == "x") == 2
    assert selection.flow_quotas(counts, 1000) == counts and selection.flow_quotas({}, 3) == {}
    more = selection.flow_quotas(counts, 9)
    assert more[("b", "x")] == more[("c", "y")] == more[("d", "x")] == 1 and sum(more.values()) == 9


def test_subsets(spark):
    rng = random.Random(9)
    rows = shapes(rng, "p1", 120, 10) + shapes(rng, "p2", 3, 2)
    got = selection.select_varied(frame(spark, rows), [("four", 4), ("twelve", 12)]).collect()
    size = {}
    for r in got:
        size.setdefault((r.request_id, r.pool_id), []).append(r)
    assert len(size["four", "p1"]) == 4 and len(size["twelve", "p1"]) == 12 and len(size["four", "p2"]) == 3
    kinds = {r.shape for r in size["twelve", "p1"]}
    assert len(kinds) >= 8 and len({r.conformer_id for r in size["twelve", "p1"]}) == 12
    assert selection.select_varied(frame(spark, rows).limit(0), [("four", 4)]).count() == 0


def brute_kinds(rows):
    ids = {(r[1], r[0]) for r in rows if r[5]}
    pool_of = {}
    for p, c in ids:
        pool_of.setdefault(c, p)
    root = {c: c for _, c in ids}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for a, b in brute(rows):
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {c: find(c) for _, c in ids}


def test_kinds_against_brute_force(spark):
    rng = random.Random(10)
    rows = shapes(rng, "p1", 160, 14, 5) + shapes(rng, "p2", 60, 6, 4) + shapes(rng, "p3", 1, 1)
    rows += [(f"line{i:03d}", "p4", "md", "eligible", None, [i * 0.9, 0.0, 0.0, 7.0, i * 0.1]) for i in range(40)]
    got = {r.conformer_id: r.shape for r in selection.shape_kinds(selection.standardized(frame(spark, rows))).collect()}
    assert got == brute_kinds(rows)


def test_records_decide_between_cells(spark):
    """The smallest records of two cells are too far apart, others aren't."""
    rng = random.Random(11)
    rows = [(f"c{i:04d}", "p", "md", "eligible", None, [rng.uniform(0, 4), rng.uniform(0, 4)]) for i in range(400)]
    got = {r.conformer_id: r.shape for r in selection.shape_kinds(selection.standardized(frame(spark, rows)), 0.12).collect()}
    ids, m = [r[0] for r in rows], np.array([r[5] for r in rows])
    z = (m - m.mean(0)) / m.std(0)
    root = {c: c for c in ids}
    for i in range(len(ids)):
        for j in range(i):
            if round(float(np.sqrt(((z[i] - z[j]) ** 2).sum())), 6) <= 0.12:
                a, b = ids[i], ids[j]
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                root[max(a, b)] = min(a, b)

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    assert got == {c: find(c) for c in ids}


def test_a_shape_of_very_many_conformers_and_constant_features(spark):
    rng = np.random.default_rng(12)
    hot = rng.normal(0, 0.02, (30_000, 12)) + np.where(np.arange(12) < 3, 0.0, 1.0)
    rare = rng.normal(0, 4, (60, 12))
    points = np.concatenate([hot, rare])
    points[:, :3] = 2.5  # constant
    rows = [(f"c{i:06d}", "p", "md" if i % 3 else "crystal", "eligible", None, x.tolist()) for i, x in enumerate(points)]
    chosen = selection.select_varied(frame(spark, rows), [("twelve", 12), ("forty", 40)]).collect()
    forty = [r for r in chosen if r.request_id == "forty"]
    assert len(chosen) == 52 and len({r.shape for r in forty}) == 40 and sum(r.shape == "c000000" for r in forty) == 1


def test_flow_of_many_combinations():
    rng = random.Random(13)
    counts = {(f"s{i}", t): rng.randint(1, 50) for i in range(4000) for t in rng.sample("abcde", rng.randint(1, 4))}
    quotas = selection.flow_quotas(counts, 2000)
    by_type = {t: sum(n for (_, x), n in quotas.items() if x == t) for t in "abcde"}
    assert sum(quotas.values()) == 2000 and max(by_type.values()) - min(by_type.values()) <= 1
    assert all(n <= counts[k] for k, n in quotas.items()) and len({s for s, _ in quotas}) == 2000
