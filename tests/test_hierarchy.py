"""Hierarchies against a walk up the parents, in both ways of numbering."""

from __future__ import annotations

import random

import pytest

from velumine.operators import hierarchy as H
from velumine.session import Workspace


def forest(spark, rows, tree_rows=H.TREE_ROWS):
    df = spark.createDataFrame(rows, "id string, parent_id string, depth int, path string, item_id string")
    return H.Forest(H.links(df, "t"), Workspace(spark, "t6"), tree_rows)


def expected(parent):
    """(depth, root) by walking up; cycles by the least id on them."""
    out = {}
    for x in parent:
        seen, at = [], x
        while at in parent and at not in seen:
            seen.append(at)
            up = parent[at]
            if up is None or up not in parent:
                out[x] = (len(seen) - 1, at)
                break
            at = up
        else:
            out[x] = (-1, min(seen[seen.index(at) :]))
    return out


def check(spark, parent, tree_rows):
    f = forest(spark, [(k, v, 9, "clash", "clash") for k, v in parent.items()] * 2, tree_rows)
    want = expected(parent)
    trees, cycles = f.trees().collect(), f.cycles().collect()
    assert {r["item_id"]: (r["depth"], r["root_id"]) for r in [*trees, *cycles]} == want
    assert len(trees) + len(cycles) == len(want)
    span = {r["item_id"]: (r["root_id"], r["lft"], r["rgt"]) for r in trees}
    for r in trees:
        chain, at = [r["item_id"]], r["item_id"]
        while parent[at] in span and at != r["root_id"]:
            at = parent[at]
            chain.append(at)
        assert r["path"] == "/".join(reversed(chain))
        above = {y for y, (root, lo, hi) in span.items() if root == r["root_id"] and lo < r["lft"] and r["rgt"] < hi}
        assert above == set(chain[1:])
        assert r["descendants"] == (r["rgt"] - r["lft"] - 1) // 2


@pytest.mark.parametrize("tree_rows", [H.TREE_ROWS, 4])
def test_random_forest(spark, tree_rows):
    rnd = random.Random(5)
    ids = [f"n{i:02d}" for i in range(40)]
    parent = {x: rnd.choice([*ids, None, "nowhere", None]) for x in ids}
    parent |= {"deep0": None, "self": "self"} | {f"deep{i}": f"deep{i - 1}" for i in range(1, 14)}
    check(spark, parent, tree_rows)


def test_blank_and_padded_parents(spark):
    f = forest(spark, [("a", " ", None, None, None), (" b ", "a ", None, None, None), ("c", "\tb", None, None, None), (None, "a", None, None, None)])
    assert {(r["item_id"], r["depth"], r["root_id"]) for r in f.trees().collect()} == {("a", 0, "a"), ("b", 1, "a"), ("c", 2, "a")}


def test_empty(spark):
    f = forest(spark, [])
    assert f.trees().count() == 0 and f.cycles().count() == 0


def test_descendants(spark):
    f = forest(spark, [(c, p, None, None, None) for c, p in (("a", None), ("b", "a"), ("c", "b"), ("d", "a"), ("x", None))])
    t = f.work.keep(f.trees())
    got = {(r["item_id"], r["descendant_id"], r["distance"]) for r in H.descendants(t, t).collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("a", "d", 1), ("b", "c", 1)}


def test_descendants_of_roots_are_listed(spark, sf_dir):
    from velumine.plans import QUERIES

    got = QUERIES["p6_descendants_all"](spark, sf_dir).groupBy("table_name", "item_id").count().collect()
    want = QUERIES["p6_ranges"](spark, sf_dir).filter("descendants > 0").collect()
    assert any(r["depth"] == 0 for r in want)
    assert {(r["table_name"], r["item_id"], r["count"]) for r in got} == {(r["table_name"], r["item_id"], r["descendants"]) for r in want}


def test_a_long_chain_takes_few_rounds(spark):
    """3,000 records below each other and a parent of 3,000 children, numbered by doubling."""
    rows = [(f"c{i:04d}", f"c{i - 1:04d}" if i else None) for i in range(3000)] + [(f"k{i:04d}", "c0000") for i in range(3000)]
    work = Workspace(spark, "t6l")
    f = H.Forest(H.links(spark.createDataFrame(rows, "id string, parent_id string"), "t"), work, 100)
    got = {r["item_id"]: (r["depth"], r["lft"], r["rgt"], len(r["path"])) for r in f.trees().filter("item_id in ('c0000', 'c0001', 'c2999', 'k0000', 'k2999')").collect()}
    assert got == {"c0000": (0, 1, 12000, 5), "c0001": (1, 2, 5999, 11), "c2999": (2999, 3000, 3001, 17999), "k0000": (1, 6000, 6001, 11), "k2999": (1, 11998, 11999, 11)}
    assert work._n < 50
