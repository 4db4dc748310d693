"""The corpus queries run over whole small tables; those with SQL give what it gives."""

from __future__ import annotations

import re

import pytest
from conftest import canonical, rows_of

from velumine.llm.queries import ORACLES, QUERIES
from velumine.session import Workspace


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    got = QUERIES[name](spark, sf_dir)
    rows = rows_of(got)
    if name in ORACLES:
        cursor = duck.execute(ORACLES[name])
        names = [d[0] for d in cursor.description]
        order = [names.index(c) for c in sorted(got.columns)]
        assert rows == sorted((tuple(canonical(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
    elif name != "p10_found":
        assert rows


@pytest.mark.parametrize("name", ["p7_found", "p7_knn"])
def test_no_plan_holds_all_searches(name, spark, sf_dir, monkeypatch):
    """The driver's memory follows its largest plan: what is run at once joins at most what one search of one table needs."""
    plans, keep = [], Workspace.keep

    def kept(self, df):
        plans.append(df)
        return keep(self, df)

    monkeypatch.setattr(Workspace, "keep", kept)
    plans.append(QUERIES[name](spark, sf_dir))
    joins = [len(re.findall(r"^\W*(?:Join|CoGroup|FlatMapCoGroups)", p._jdf.queryExecution().optimizedPlan().toString(), re.M)) for p in plans]
    assert len(plans) > 3 and max(joins) <= 10, joins
