"""Operators that change or keep account, beside the queries that hold them against SQL."""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from velumine.operators import code, indexes, ranking, search, state
from velumine.operators import relational as R
from velumine.session import Workspace, checkpoint_root


def vectors(n=300, dims=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    return [(i, (centres[i % 12] + rng.normal(size=dims) * 0.3).tolist()) for i in range(n)]


@pytest.mark.parametrize(("name", "options"), [("hnsw", {"m": 8, "part_rows": 100}), ("ivf", {"n_lists": 6, "n_probe": 3}), ("pq", {"m": 8, "k_sub": 32})])
def test_added_rows_are_found_and_deleted_ones_are_not(spark, name, options):
    rows = vectors()
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    index = indexes.create(name, dims=16, **options).fit(df.filter("id < 200"))
    more = index.add(df.filter("id >= 200"))
    assert index.df.count() == 200 and more.df.count() == 300
    assert more.search(rows[250][1], 1).first()["id"] == 250
    fewer = more.delete(df.filter("id = 250"))
    assert 250 not in {r["id"] for r in fewer.search(rows[250][1], 5).collect()} and fewer.df.count() == 299


def test_small_world_against_all():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 24))
    graph = indexes.SmallWorld(x, 12, 80)
    graph.build(np.sort(np.floor(-np.log(rng.uniform(size=800)) / np.log(12)).astype(int))[::-1])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = sum(len({i for _, i in graph.find(q, 10, 80)} & set(np.argsort(-(u @ q))[:10].tolist())) for q in u[::20])
    assert hits >= 0.9 * 400
    assert max(len(layer) for near in graph.near for layer in near) <= 24
    assert indexes.SmallWorld(np.zeros((0, 4)), 4, 10).find(np.ones(4), 3, 10) == []


def test_batch_search_takes_what_is_dirty(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [0.0, 1.0]), (7, [1.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = df.filter("id in (1, 3)").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    got = search.knn_batch(df, q, 2)
    assert [(r["id"], r["rank"]) for r in got.filter("query_id = 1").orderBy("rank").collect()][0] == (2, 1)
    assert got.filter("query_id = 3 and similarity <> 0").count() == 0 and search.knn_batch(df.limit(0), q, 2).count() == 0


def test_ranks_over_ranges(spark):
    rng = np.random.default_rng(2)
    rows = [(i, None if i % 17 == 0 else float(rng.integers(0, 20))) for i in range(500)]
    got = {r["id"]: r["place"] for r in ranking.global_rank(spark.createDataFrame(rows, "id long, s double").repartition(5), "s", "id", "place", Workspace(spark, "rank")).collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {i: n for n, (i, _) in enumerate(order, 1)}


def test_custom_aggregate_merges_parts(spark):
    df = spark.createDataFrame([("hot", i) for i in range(1000)] + [("cold", 1), (None, 5)], "k string, v long")
    got = R.folded(df, ["k"], ["v"], lambda rows: {"n": len(rows), "s": int(rows["v"].sum())}, lambda parts: {"n": sum(p["n"] for p in parts), "s": sum(p["s"] for p in parts)}, "n long, s long")
    assert {r["k"]: (r["n"], r["s"]) for r in got.collect()} == {"hot": (1000, 499500), "cold": (1, 1), None: (1, 5)}


def test_lru():
    c = state.LruCache(2)
    c.put("a", 1)
    c.put("b", 2)
    assert c.get("a") == 1
    c.put("c", 3)
    assert c.get("b") is None and c.get("a") == 1
    c.put("d", 4, 10, datetime(2026, 1, 1))
    assert c.get("d", datetime(2026, 1, 1, 0, 0, 9)) == 4 and c.get("d", datetime(2026, 1, 1, 0, 0, 11)) is None
    assert state.cache_key("q", level=1) != state.cache_key("q", level=2) == state.cache_key("q", level=2)


def test_relationships(spark):
    text = "defmodule A.B do\n  alias C.D\n  defdelegate run(x), to: D\n  def go(x) do\n    D.step(x)\n    run(x)\n    %E{x: 1}\n  end\nend\n"
    df = spark.createDataFrame([("u", text, "Elixir")], "id string, source_text string, language string")
    nodes = spark.createDataFrame([("f:run", "run", "function")], "id string, name string, type string")
    got = {(r["source_id"], r["target_id"], r["type"], r["confidence"]) for r in code.relationships(df, "elixir", nodes).collect()}
    assert ("u", "f:run", "calls", "EXTRACTED") in got and ("u", "module:C.D", "imports", "EXTRACTED") in got
    assert ("u:A.B", "u:go", "contains", "EXTRACTED") in got and ("u:A.B", "u:run", "contains", "EXTRACTED") in got
    assert ("u", "module:D", "references", "INFERRED") in got and ("u", "module:E", "references", "INFERRED") in got
    assert [tuple(r)[1:] for r in code.qualified_calls(df, "elixir").collect()] == [("D", "step", 5)]


def test_tenants_keep_to_their_folder():
    assert state.tenant_path("s3a://x/", "a-1") == "s3a://x/tenants/a-1"
    for bad in ("", "..", "a/b", "/a"):
        with pytest.raises(ValueError):
            state.tenant_path("root", bad)


def test_a_cluster_without_a_shared_folder_is_an_error(monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        checkpoint_root(Session())


