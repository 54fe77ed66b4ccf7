from __future__ import annotations

import datetime as dt
import random

import numpy as np

from scorelake.functions import field61
from scorelake.operators.reconcile import Field, Key, reconcile

KEY = [Key("k"), Key("part", "tail_lower")]
FIELDS = [Field("score", "number"), Field("text"), Field("digest", "hex"), Field("at", "time")]
SCHEMA = "k string, part string, score string, text string, digest string, at timestamp, version timestamp, element int, bucket string"
T = [dt.datetime(2025, 1, d) for d in range(1, 9)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def test_field_arithmetic():
    rng = random.Random(3)
    a = [rng.randrange(field61.P) for _ in range(500)] + [0, 1, field61.P - 1]
    b = [rng.randrange(field61.P) for _ in range(500)] + [field61.P - 1, 0, field61.P - 1]
    x, y = np.array(a, np.uint64), np.array(b, np.uint64)
    assert [int(v) for v in field61.mul(x, y)] == [p * q % field61.P for p, q in zip(a, b)]
    assert [int(v) for v in field61.add(x, y)] == [(p + q) % field61.P for p, q in zip(a, b)]
    assert [int(v) for v in field61.sub(x, y)] == [(p - q) % field61.P for p, q in zip(a, b)]


def test_differences_are_recovered_or_refused():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(120):
        base = rng.integers(0, field61.ELEMENTS, 30)
        sets.append((np.concatenate([base, rng.integers(0, field61.ELEMENTS, rng.integers(0, 7))]), np.concatenate([base, rng.integers(0, field61.ELEMENTS, rng.integers(0, 7))])))
    at = field61.points(10)
    flat = lambda i: (np.concatenate([s[i] for s in sets]), np.concatenate([[0], np.cumsum([len(s[i]) for s in sets])]))
    (va, oa), (vb, ob) = flat(0), flat(1)
    found = field61.difference(np.diff(oa), np.diff(ob), field61.characteristic(va, oa, at), field61.characteristic(vb, ob, at), at, 2)
    for (a, b), x in zip(sets, found):
        a, b = set(a.tolist()), set(b.tolist())
        if len(a ^ b) <= 8:
            assert x is not None and (set(x[0]), set(x[1])) == (a - b, b - a)
        else:
            assert x is None


def test_spellings_and_versions(spark, rows):
    a = [("A1", "X_Aligned", "-7.5", "ok", "AB12", T[0], T[0]), ("A1", "X_Aligned", "-9", "ok", "AB12", T[0], T[1]), ("B", "Y_z", None, "ok", None, T[0], T[0]), ("C", None, "1", "", "N/A", None, None), ("D", "d_d", "2", "ok", "ff", T[2], T[0]), ("E", "e_e", "3", "x", "ff", T[2], T[0])]
    b = [(" a1 ", "x_ALIGNED", "-9,0000001", "OK ", "sha256:ab12", T[0], T[0]), ("b", "y_z", "NaN", "Ok", "", T[0], T[0]), ("c", None, "1.0", None, "", None, None), ("D", "d_d", "2.1", "warn", "FE", T[3], T[5]), ("F", "f_F", "3", "x", "ff", T[2], T[0])]
    got = rows(reconcile(frame(spark, a), frame(spark, b), KEY, FIELDS, "version"))
    assert got == [("D|D_d", "differs", "at"), ("D|D_d", "differs", "digest"), ("D|D_d", "differs", "score"), ("D|D_d", "differs", "text"), ("E|E_e", "missing_in_mirror", ""), ("F|F_f", "missing_in_primary", "")]


def test_empty_sides_and_repeats(spark, rows):
    some = [("A", "p_q", "1", "t", "aa", T[0], T[0])] * 5
    assert rows(reconcile(frame(spark, some), frame(spark, []), KEY, FIELDS, "version")) == [("A|P_q", "missing_in_mirror", "")]
    assert rows(reconcile(frame(spark, []), frame(spark, some), KEY, FIELDS, "version")) == [("A|P_q", "missing_in_primary", "")]
    assert rows(reconcile(frame(spark, []), frame(spark, []), KEY, FIELDS, "version")) == []


def test_many_differences_in_one_bucket_and_long_texts(spark, rows):
    """Bounds double until verified; beyond the last bound the bucket is split by further bits of a hash."""
    n = 150
    a = [(f"k{i}", "p_q", str(i), "x" * (20000 if i == 7 else 1), None, T[0], T[0]) for i in range(n)]
    b = [(f"k{i}", "p_q", str(i + (i % 3 == 0)), "x" * (20000 if i == 7 else 1), None, T[0], T[0]) for i in range(n)]
    got = rows(reconcile(frame(spark, a), frame(spark, b), KEY, FIELDS, "version", bucket_rows=1000))
    assert got == sorted((f"K{i}|P_q", "differs", "score") for i in range(0, n, 3))


def test_an_empty_side_of_full_buckets(spark, rows):
    """Buckets of a thousand rows that one side lacks altogether are split until all are recovered by sketches."""
    some = [(f"k{i}", "p_q", str(i), "t", None, T[0], T[0]) for i in range(3000)]
    got = reconcile(frame(spark, some), frame(spark, []), KEY, FIELDS, "version", bucket_rows=1000)
    assert rows(got) == sorted((f"K{i}|P_q", "missing_in_mirror", "") for i in range(3000))
