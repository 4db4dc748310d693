"""Streams give what batches give."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from velumine.sources.tables import load
from velumine.streaming import operators as T


@pytest.fixture(scope="module")
def events(spark, sf_dir, tmp_path_factory):
    """(static, stream): the events in four files, read one file at a time."""
    df = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = str(tmp_path_factory.mktemp("events") / "t")
    # One more late event far ahead closes all windows of the others.
    last = df.limit(1).withColumns({"ts": F.expr("timestamp'2030-01-01'"), "event_type": F.lit("last"), "user_id": F.lit(-1).cast("long"), "event_id": F.lit(-1).cast("long")})
    parts = df.repartitionByRange(3, "ts").sortWithinPartitions("ts")
    parts.coalesce(3).write.parquet(path)
    last.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return df, stream


def run(spark, df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_tumbling(spark, events, tmp_path):
    static, stream = events
    got = run(spark, T.tumbling(stream, width="6 hours", late="60 days"), "tumbling", tmp_path)
    assert rows(got.filter("event_type <> 'last'")) == rows(T.tumbling(static, width="6 hours"))


def test_sliding(spark, events, tmp_path):
    static, stream = events
    got = run(spark, T.sliding(stream, late="60 days"), "sliding", tmp_path)
    assert rows(got.filter("event_type <> 'last'")) == rows(T.sliding(static))


def test_sessions(spark, events, tmp_path):
    static, stream = events
    got = run(spark, T.sessions(stream, gap="2 hours", late="60 days"), "sessions", tmp_path)
    assert rows(got.filter("user_id <> -1")) == rows(T.sessions(static, gap="2 hours"))


def test_deduplicate(spark, events, tmp_path):
    static, stream = events
    got = run(spark, T.deduplicate(stream, "event_id", late="60 days").select("event_id"), "dedup", tmp_path)
    assert got.filter("event_id <> -1").count() == static.select("event_id").distinct().count()


def test_percolate_and_sink(spark, sf_dir, tmp_path):
    e = load(spark, sf_dir, "embeddings")
    triggers = e.filter("vec_id < 5").select(F.col("vec_id").alias("trigger_id"), F.col("embedding").alias("query_vector"), F.lit(0.3).alias("threshold"), F.lit(True).alias("active"))
    docs = e.select(F.col("vec_id").alias("doc_id"), "embedding")
    docs.write.parquet(str(tmp_path / "docs"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs"))
    T.upsert_sink(T.percolate(stream, triggers), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert rows(got) == rows(T.percolate(docs, triggers))


def test_expiring_cache(spark, events, tmp_path):
    static, stream = events
    got = run(spark, T.expiring_cache(stream, "user_id", late="60 days"), "ttl", tmp_path, "update")
    n = {r["key"]: r["n"] for r in got.groupBy("key").agg(F.max("updates").alias("n")).collect()}
    want = {str(r["user_id"]): r["n"] for r in static.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {k: v for k, v in n.items() if k != "-1"} == want
    assert got.filter("expired").select("key").distinct().count() == len(want)


def test_refresh_of_centroids_and_ranks(spark, tmp_path):
    from velumine.operators.search import centroids

    vectors = spark.createDataFrame([(i, [float(i), float(-i)], i % 2) for i in range(12)], "id long, embedding array<double>, label int")
    vectors.repartition(3).write.parquet(str(tmp_path / "v"))
    stream = spark.readStream.schema(vectors.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "v"))
    T.refresh_centroids(stream, "label", str(tmp_path / "c"), str(tmp_path / "k")).awaitTermination()
    got = {r["label"]: (r["centroid"], r["n"]) for r in T.centroids_of(spark, str(tmp_path / "c"), "label").collect()}
    want = {r["label"]: (r["centroid"], r["n"]) for r in centroids(vectors, "label").collect()}
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0]) for k in want)
    T.refresh_pagerank(stream, lambda: vectors.select("id"), str(tmp_path / "r"), str(tmp_path / "k2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "r")).count() >= 12
