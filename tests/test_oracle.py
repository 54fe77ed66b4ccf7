"""Every query with a SQL counterpart gives the same rows as DuckDB on the smallest tables."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from scorelake.plans import base, training_sql

SQL = base.SQL | training_sql.SQL


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return round(float(x), 5) + 0.0 if isinstance(x, float) else x


def table(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def db(folder):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, folder, db, name):
    df = entry.queries()[name](spark, folder)
    columns = sorted(df.columns)
    got = table(df.select(*columns).collect())
    want = table(db.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-5) for x, y in zip(a, b)), (a, b)


def test_every_query_has_a_name_and_entry_runs(spark, folder):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
