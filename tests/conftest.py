"""One local session for all tests; workers import the package from the repository."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from scorelake.session import local_session

    session = local_session("4", 4, "4g")
    # Tables are tiny here and plans many: compiling them takes longer than interpreting them.
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    if not Path(DATA).exists():
        pytest.skip("no test data")
    return DATA


@pytest.fixture(scope="session")
def rows():
    """A table's rows as sorted tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))
