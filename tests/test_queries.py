"""Every query of the core with SQL gives what the SQL gives; the others run and keep their schema."""

from __future__ import annotations

import pytest
from conftest import canonical, rows_of

from velumine.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    got = QUERIES[name](spark, sf_dir)
    rows = rows_of(got)
    if name not in ORACLES:
        assert got.columns and len(rows) >= 0
        return
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    order = [names.index(c) for c in sorted(got.columns)]
    want = sorted((tuple(canonical(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
    assert rows == want


def test_entry_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "knn_hybrid" in entry.queries()
