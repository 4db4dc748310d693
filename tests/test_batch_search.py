"""Batch search asks for every vector whose id is divisible by 50, in blocks where the queries are many."""

from __future__ import annotations

from pyspark.sql import functions as F

from velumine.operators import search
from velumine.plans import QUERIES
from velumine.sources.tables import load


def test_all_required_queries_have_rows(spark, sf_dir):
    want = {r[0] for r in load(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select("vec_id").collect()}
    assert max(want) >= 20
    assert {r["query_id"] for r in QUERIES["knn_batch_50"](spark, sf_dir).collect()} == want
    assert {r["query"] for r in QUERIES["eval_metrics_50"](spark, sf_dir).collect()} == want
    assert QUERIES["eval_report_50"](spark, sf_dir).first()["n"] == len(want)


def test_queries_in_blocks(spark, sf_dir):
    df = load(spark, sf_dir, "embeddings").filter("vec_id < 100")
    queries = df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    key = lambda d: sorted((r["query_id"], r["rank"], r["id"]) for r in d.collect())
    assert key(search.knn_batch(df, queries, 3, id_col="vec_id", bound=40)) == key(search.knn_batch(df, queries, 3, id_col="vec_id"))
