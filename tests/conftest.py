"""One session for all tests, and comparison helpers."""

from __future__ import annotations

import glob
import os

import pytest

from velumine.session import get_spark

DATA = os.environ.get("VELUMINE_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def canonical(v):
    """A value as both engines give it."""
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(canonical(x) for x in v)
    return float(v) if type(v).__name__ == "Decimal" else v


def rows_of(df) -> list[tuple]:
    cols = sorted(df.columns)
    return sorted((tuple(canonical(r[c]) for c in cols) for r in df.collect()), key=repr)
