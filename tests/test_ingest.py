"""Ingestion, saved indexes, table functions and rate limits."""

from __future__ import annotations

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from velumine.operators import indexes, ingest, ranking, search
from velumine.plans import QUERIES

DOCS = [(1, "Shards hold data. Queries find it.\n\nA second part about tensors."), (2, "Nothing here."), (3, None), (4, "")]


def test_documents(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    chunks = ingest.index_documents(docs)
    rows = chunks.collect()
    assert {r["doc_id"] for r in rows} == {"1", "2"} and all(len(r["embedding"]) == 64 for r in rows)
    assert sorted(r["level"] for r in rows if r["doc_id"] == "1") == ["document", "paragraph", "paragraph", "sentence", "sentence", "sentence"]
    routing = ingest.shard_routing(chunks, ranking.terms_of)
    assert routing.count() == 3 and routing.filter(search.may_hold(F.col("bloom"), "Tensors", size=100_000)).count() == 3
    d, c = ingest.delete_documents(docs, chunks, docs.filter("doc_id = 1"))
    assert d.count() == 3 and {r["doc_id"] for r in c.collect()} == {"2"}
    assert ingest.sampled_centroid(chunks, "level", rows=1).count() == 3


def test_source_files(spark):
    files = [("lib/a.ex", "defmodule A do\n  def run(x) do\n    helper(x)\n    other(x)\n  end\n\n  def helper(x), do: x\nend\n"), ("b.py", "class B:\n    def go(self):\n        step(1)\n# def no(): pass\n"), ("c.txt", "def x")]
    nodes, edges = ingest.source_files(spark.createDataFrame(files, "path string, text string"))
    assert {r["id"] for r in nodes.collect()} == {"lib/a.ex:A:1", "lib/a.ex:run:2", "lib/a.ex:helper:7", "b.py:B:1", "b.py:go:2"}
    got = {(r["source_id"], r["target_id"], r["type"], r["confidence"]) for r in edges.collect()}
    assert ("lib/a.ex:run:2", "lib/a.ex:helper:7", "calls", "EXTRACTED") in got and ("lib/a.ex:run:2", "external:other", "calls", "INFERRED") in got
    assert ("lib/a.ex:A:1", "lib/a.ex:run:2", "contains", "EXTRACTED") in got and ("b.py:go:2", "external:step", "calls", "INFERRED") in got
    assert ingest.edge_blooms(edges).count() == 2


def test_filters_answer_for_all_their_terms(spark):
    terms = spark.createDataFrame([("a", "X"), ("a", "y"), ("b", "x"), ("b", "z"), ("c", "x"), (None, "x")], "k string, t string")
    blooms = search.bloom_build(terms.filter("t <> 'z' and k <> 'c'"), "k", "t")
    assert {r["k"]: r["holds"] for r in search.all_held(terms, blooms, "k", "t").collect()} == {"a": True, "b": False, "c": False}


def test_edge_filters_of_many_ends(spark, tmp_path):
    """With a whole filter beside each end, this ran out of memory."""
    odd = [(None, "a", "b"), ("CALLS ", None, "A"), ("calls", " ", None), ("uses", "", " "), ("has", "a", "a")]
    many = spark.range(60_000).select(F.lit("calls").alias("type"), F.concat(F.lit("s"), "id").alias("source_id"), F.concat(F.lit("t"), "id").alias("target_id"))
    many.union(spark.createDataFrame(odd, "type string, source_id string, target_id string")).write.parquet(str(tmp_path / "edges.parquet"))
    began = time.monotonic()
    assert {tuple(r) for r in QUERIES["edge_filters"](spark, str(tmp_path)).select("type", "holds").collect()} == {("calls", True), ("has", True)}
    assert time.monotonic() - began < 30


@pytest.mark.parametrize("name", ["exact", "ivf", "binary"])
def test_saved_index(spark, tmp_path, name):
    rows = [(i, [float((i * j) % 7 - 3) for j in range(1, 17)]) for i in range(1, 40)]
    index = indexes.create(name, dims=16, **({"n_lists": 3, "n_probe": 2} if name == "ivf" else {})).fit(spark.createDataFrame(rows, "id long, embedding array<double>"))
    index.save(str(tmp_path / "i"))
    again = indexes.load(spark, str(tmp_path / "i"))
    assert [r["id"] for r in again.search(rows[4][1], 5).collect()] == [r["id"] for r in index.search(rows[4][1], 5).collect()]


def test_table_function(spark):
    ingest.register(spark)
    spark.createDataFrame([(1, "abcdefgh"), (2, None)], "id long, text string").createOrReplaceTempView("texts")
    got = spark.sql("SELECT id, c.text FROM texts, LATERAL chunk_text(text, 4, 1) c").collect()
    assert [r["text"] for r in got] == ["abcd", "defg", "gh"]


def test_rate_limit(spark):
    t = datetime(2025, 1, 1)
    df = spark.createDataFrame([("k", t + timedelta(seconds=s)) for s in (0, 0, 0, 1, 5)], "key string, ts timestamp_ntz").withColumn("n", F.monotonically_increasing_id())
    got = ingest.within_budget(df, "key", ["ts", "n"], 1.0, 2.0).orderBy("ts", "n").collect()
    assert [r["allowed"] for r in got] == [True, True, False, True, True]
