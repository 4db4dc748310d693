"""Evaluation, memory, cache, trigger, pipeline and event-window queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velumine.functions import vector as V
from velumine.operators import evaluation as E
from velumine.operators import memory as M
from velumine.operators import relational as R
from velumine.operators import search
from velumine.operators import state as S
from velumine.plans.engine import Engine
from velumine.plans.registry import query
from velumine.sources.tables import load
from velumine.streaming import operators as T

_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_EVENTS = f"""qs AS (SELECT vec_id AS query, label, embedding FROM embeddings WHERE vec_id < 20),
p AS (SELECT q.query, q.label AS ql, e.vec_id AS id, e.label, {_COS} AS sim FROM embeddings e, qs q WHERE e.vec_id <> q.query),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) AS rn FROM p QUALIFY rn <= 10),
x AS (SELECT query, any_value(ql) AS ql, list(id ORDER BY rn) AS retrieved, list(CASE WHEN label = ql THEN 1.0::DOUBLE ELSE 0.0 END ORDER BY rn) AS rel FROM r GROUP BY query),
w AS (SELECT q.query, list(e.vec_id ORDER BY e.vec_id) AS expected FROM qs q JOIN embeddings e ON e.label = q.label AND e.vec_id <> q.query GROUP BY 1),
v AS (SELECT x.query, retrieved, rel, expected FROM x JOIN w USING (query))"""


_EVENTS_50 = _EVENTS.replace("vec_id < 20", "vec_id % 50 = 0")


def _events(spark: SparkSession, sf_dir: str, asked: str = "vec_id < 20") -> DataFrame:
    """Searches of the vectors ``asked`` for, twenty stated ones by default, each expected to find the vectors of its label."""
    df = load(spark, sf_dir, "embeddings")
    qs = df.filter(asked).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = search.knn_batch(df, qs, 10, id_col="vec_id")
    labels = df.select(F.col("vec_id").alias("id"), "label")
    ql = df.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql"))
    rows = found.join(labels, "id").join(ql, "query_id")
    got = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", (F.col("label") == F.col("ql")).cast("double").alias("rel")))).alias("_r"))
    sizes = df.groupBy(F.col("label").alias("ql")).agg(F.count(F.lit(1)).alias("_n"))
    want = ql.join(sizes, "ql").select("query_id", (F.col("_n") - 1).alias("expected_count"))
    out = got.join(want, "query_id")
    hits = F.transform(F.filter("_r", lambda x: x["rel"] == 1.0), lambda x: x["id"])
    return out.select(F.col("query_id").alias("query"), F.lit("knn").alias("event_type"), F.transform("_r", lambda x: x["id"]).alias("retrieved_ids"), hits.alias("expected_ids"), "expected_count", F.transform("_r", lambda x: x["rel"]).alias("relevance_scores"))


_METRICS = """round(length(list_filter(list_slice(retrieved, 1, 5), lambda x: list_contains(expected, x))) / 5.0::DOUBLE, 4) AS precision_5,
round(length(list_filter(list_slice(retrieved, 1, 5), lambda x: list_contains(expected, x))) / length(expected)::DOUBLE, 4) AS recall_5,
coalesce(round(1.0::DOUBLE / list_position(list_transform(retrieved, lambda x: list_contains(expected, x)), true), 4), 0) AS mrr,
CASE WHEN list_sum(rel) = 0 THEN 0 ELSE round(list_sum(list_transform(range(1, 11), lambda i: rel[i] / log2(i + 1))) / list_sum(list_transform(range(1, 11), lambda i: list_reverse_sort(rel)[i] / log2(i + 1))), 4) END AS ndcg_10"""


@query("eval_metrics", f"WITH {_EVENTS} SELECT query, {_METRICS} FROM v")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.score(_events(spark, sf_dir)).select("query", "precision_5", "recall_5", "mrr", "ndcg_10")


@query("eval_report", f"WITH {_EVENTS}, m AS (SELECT query, {_METRICS} FROM v) SELECT 'knn' AS event_type, count(*) AS n, round(avg(precision_5), 4) AS precision_5, round(avg(recall_5), 4) AS recall_5, round(avg(mrr), 4) AS mrr, round(avg(ndcg_10), 4) AS ndcg_10 FROM m")
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.report(E.score(_events(spark, sf_dir)))


@query("eval_monitor", f"""WITH {_EVENTS}, m AS (SELECT query, {_METRICS} FROM v), a AS (SELECT round(avg(precision_5), 4) AS p, round(avg(recall_5), 4) AS r FROM m)
SELECT 'knn' AS event_type, metric, current, threshold FROM (SELECT 'precision_5' AS metric, p AS current, 0.99::DOUBLE AS threshold FROM a UNION ALL SELECT 'recall_5', r, 0.5::DOUBLE FROM a) WHERE current < threshold""")
def eval_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.violations(E.report(E.score(_events(spark, sf_dir))), {"precision_5": 0.99, "recall_5": 0.5})


@query("eval_metrics_50", f"WITH {_EVENTS_50} SELECT query, {_METRICS} FROM v")
def eval_metrics_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.score(_events(spark, sf_dir, "vec_id % 50 = 0")).select("query", "precision_5", "recall_5", "mrr", "ndcg_10")


@query("eval_report_50", f"WITH {_EVENTS_50}, m AS (SELECT query, {_METRICS} FROM v) SELECT 'knn' AS event_type, count(*) AS n, round(avg(precision_5), 4) AS precision_5, round(avg(recall_5), 4) AS recall_5, round(avg(mrr), 4) AS mrr, round(avg(ndcg_10), 4) AS ndcg_10 FROM m")
def eval_report_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.report(E.score(_events(spark, sf_dir, "vec_id % 50 = 0")))


@query("eval_monitor_50", f"""WITH {_EVENTS_50}, m AS (SELECT query, {_METRICS} FROM v), a AS (SELECT round(avg(precision_5), 4) AS p, round(avg(recall_5), 4) AS r FROM m)
SELECT 'knn' AS event_type, metric, current, threshold FROM (SELECT 'precision_5' AS metric, p AS current, 0.99::DOUBLE AS threshold FROM a UNION ALL SELECT 'recall_5', r, 0.5::DOUBLE FROM a) WHERE current < threshold""")
def eval_monitor_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.violations(E.report(E.score(_events(spark, sf_dir, "vec_id % 50 = 0"))), {"precision_5": 0.99, "recall_5": 0.5})


@query("eval_latency", """WITH s AS (SELECT event_type, list(value ORDER BY value) AS v FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT event_type, v[(round(0.5 * (length(v) - 1)) + 1)::INT] AS p50, v[(round(0.95 * (length(v) - 1)) + 1)::INT] AS p95, v[(round(0.99 * (length(v) - 1)) + 1)::INT] AS p99 FROM s""")
def eval_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.latencies(load(spark, sf_dir, "events").withColumnRenamed("value", "latency_ms"))


# Memory. The tables hold each memory's rows alike, so any row of an id stands for it.

_MEM = "m AS (SELECT DISTINCT ON (k) trim(id) AS k, * EXCLUDE (id, type), lower(trim(type)) AS type FROM memories ORDER BY k)"
_NOW = datetime(2026, 1, 15)
_NOW_SQL = "TIMESTAMP '2026-01-15'"


def _memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.clean(load(spark, sf_dir, "memories"))


def _now() -> F.Column:
    return F.lit(_NOW).cast("timestamp_ntz")


@query("memory_stats", f"""WITH {_MEM} SELECT session_id, count(*) AS total, count(*) FILTER (type = 'episodic' AND coalesce(forgotten, 0) = 0) AS episodic, count(*) FILTER (type = 'semantic' AND coalesce(forgotten, 0) = 0) AS semantic,
count(*) FILTER (type = 'procedural' AND coalesce(forgotten, 0) = 0) AS procedural, count(*) FILTER (type = 'working' AND coalesce(forgotten, 0) = 0) AS working, count(*) FILTER (forgotten = 1) AS forgotten, round((sum(importance::DECIMAL(18,6)) / count(importance))::DOUBLE + 1e-9, 3) AS avg_importance FROM m GROUP BY 1""")
def memory_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.stats(_memories(spark, sf_dir))


@query("memory_score", f"""WITH {_MEM} SELECT k AS id, round(0.8 * coalesce(importance, 0.5) / (1 + coalesce(date_sub('second', created_at, {_NOW_SQL}) / 3600.0, 0.0) / 168.0) * (1 + ln(1 + coalesce(access_count, 0)) / 10.0), 4) AS score FROM m""")
def memory_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memories(spark, sf_dir).select("id", M.score(F.lit(0.8), F.col("importance"), F.col("access_count"), F.col("created_at"), _now()).alias("score"))


@query("memory_recall", f"""WITH {_MEM}, q AS (SELECT * FROM embeddings WHERE vec_id = 1), h AS (SELECT k, importance, access_count, created_at FROM m WHERE coalesce(forgotten, 0) = 0),
r AS (SELECT *, ('0x' || left(md5(k), 8))::BIGINT % (SELECT count(*) FROM embeddings) AS v FROM h), s AS (SELECT r.*, {_COS} AS sim FROM r JOIN embeddings e ON e.vec_id = r.v, q ORDER BY sim DESC, k LIMIT 20)
SELECT k AS id, round(sim * coalesce(importance, 0.5) / (1 + coalesce(date_sub('second', created_at, {_NOW_SQL}) / 3600.0, 0.0) / 168.0) * (1 + ln(1 + coalesce(access_count, 0)) / 10.0), 4) AS score FROM s ORDER BY score DESC, k LIMIT 10""")
def memory_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories given vectors of the embeddings by a hash of their id, since the table has none."""
    e = load(spark, sf_dir, "embeddings")
    n = e.count()
    m = _memories(spark, sf_dir).filter(F.coalesce("forgotten", F.lit(0)) == 0)
    m = m.withColumn("vec_id", F.pmod(F.conv(F.left(F.md5("id"), F.lit(8)), 16, 10).cast("long"), F.lit(n))).join(e.select("vec_id", "embedding"), "vec_id")
    q = list(e.filter("vec_id = 1").first()["embedding"])
    return M.recall(m, q, _now(), 10).select("id", "score")


@query("memory_related", """WITH e AS (SELECT DISTINCT nullif(trim(source_id), '') AS s, nullif(trim(target_id), '') AS t, type, weight FROM memory_edges),
h AS (SELECT DISTINCT trim(id) AS id FROM memories WHERE session_id = 'sess-main' AND importance >= 0.95), k AS (SELECT DISTINCT trim(id) AS id FROM memories),
b AS (SELECT s AS hit_id, t AS id, type, weight FROM e UNION SELECT t, s, type, weight FROM e)
SELECT hit_id, id, type, weight FROM b WHERE hit_id IN (SELECT id FROM h) AND id IN (SELECT id FROM k) QUALIFY row_number() OVER (PARTITION BY hit_id ORDER BY weight DESC NULLS LAST, id, type) <= 10""")
def memory_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _memories(spark, sf_dir)
    e = load(spark, sf_dir, "memory_edges").select(F.nullif(F.trim("source_id"), F.lit("")).alias("source_id"), F.nullif(F.trim("target_id"), F.lit("")).alias("target_id"), "type", "weight").distinct()
    return M.related(m.filter("session_id = 'sess-main' and importance >= 0.95"), e, m).select("hit_id", "id", "type", "weight")


@query("memory_consolidate", f"""WITH {_MEM}, o AS (SELECT k, session_id, coalesce(tags[1], 'general') AS tag, importance, created_at, content FROM m WHERE type = 'episodic' AND coalesce(forgotten, 0) = 0 AND date_sub('hour', created_at, {_NOW_SQL}) > 24),
g AS (SELECT * FROM o WHERE session_id IN (SELECT session_id FROM o GROUP BY 1 HAVING count(*) >= 10)),
f AS (SELECT *, row_number() OVER (PARTITION BY session_id, tag ORDER BY created_at, k) AS r FROM g)
SELECT session_id, tag, count(*) AS n, round((sum(importance::DECIMAL(18,6)) / count(importance))::DOUBLE + 1e-9, 3) AS importance, string_agg('- ' || left(coalesce(content, ''), 200), E'\\n' ORDER BY r) FILTER (r <= 20) AS summary FROM f GROUP BY 1, 2""")
def memory_consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.consolidate(_memories(spark, sf_dir), _now())


@query("memory_timeline", f"WITH {_MEM} SELECT k AS id, created_at FROM m WHERE session_id = 'sess-main' ORDER BY created_at DESC NULLS LAST, k LIMIT 50")
def memory_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.timeline(_memories(spark, sf_dir), "sess-main").select("id", "created_at")


@query("memory_forget", "SELECT count(DISTINCT trim(id)) AS forgotten FROM memories WHERE forgotten = 1 OR importance < 0.1")
def memory_forget(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _memories(spark, sf_dir)
    return M.forget(m, m.filter("importance < 0.1"), _now()).agg(F.count_if(F.col("forgotten") == 1).alias("forgotten"))


# Cache, triggers, pipelines


@query("trigger_match", f"""WITH q AS (SELECT vec_id AS trigger_id, embedding FROM embeddings WHERE vec_id < 10)
SELECT trigger_id, e.vec_id AS doc_id, round({_COS}, 6) AS similarity FROM embeddings e, q WHERE e.vec_id >= 10 AND {_COS} >= 0.3""")
def trigger_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    t = e.filter("vec_id < 10").select(F.col("vec_id").alias("trigger_id"), F.col("embedding").alias("query_vector"), F.lit(0.3).alias("threshold"), F.lit(True).alias("active"))
    d = e.filter("vec_id >= 10").select(F.col("vec_id").alias("doc_id"), "embedding")
    return S.match_triggers(d, t).withColumn("similarity", F.round("similarity", 6))


@query("cache_lookup", f"WITH q AS (SELECT * FROM embeddings WHERE vec_id = 1) SELECT e.vec_id AS cache_key, round({_COS}, 6) AS similarity FROM embeddings e, q WHERE e.vec_id % 2 = 1 AND {_COS} >= 0.92 ORDER BY {_COS} DESC, e.vec_id LIMIT 1")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache that holds every vector; those of odd id have not expired."""
    e = load(spark, sf_dir, "embeddings")
    later = F.when(F.col("vec_id") % 2 == 1, F.expr("timestamp_ntz'2027-01-01'")).otherwise(F.expr("timestamp_ntz'2025-01-01'"))
    q = list(e.filter("vec_id = 1").first()["embedding"])
    out = S.cache_lookup(e.select(F.col("vec_id").alias("cache_key"), "embedding", later.alias("expires_at")), q, _now())
    return out.select("cache_key", F.round("similarity", 6).alias("similarity"))


@query("cache_stats", "SELECT count(*) AS entries, count(*) FILTER (vec_id % 2 = 1) AS active FROM embeddings")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    later = F.when(F.col("vec_id") % 2 == 1, F.expr("timestamp_ntz'2027-01-01'")).otherwise(F.expr("timestamp_ntz'2025-01-01'"))
    return S.cache_stats(load(spark, sf_dir, "embeddings").select(later.alias("expires_at")), _now())


@query("pipeline_run", f"""WITH q AS (SELECT * FROM embeddings WHERE vec_id = 1), s AS (SELECT e.vec_id AS id, {_COS} AS sim FROM embeddings e, q WHERE {_COS} >= 0.1)
SELECT id, round(0.6 * sim + 0.04 + 0.1, 6) AS score FROM s ORDER BY 0.6 * sim DESC, id LIMIT 15""")
def pipeline_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.lit(None).cast("double").alias("importance"))
    q = list(e.filter("id = 1").first()["embedding"])
    p = S.Pipeline("related", [("search", {"query": q}), ("filter", {"min_relevance": 0.1}), ("deduplicate", {}), ("rank", {}), ("limit", {"count": 15})])
    return p.run(e).select("id", F.round("score", 6).alias("score"))


@query("engine_sql", "SELECT event_type, count(*) AS n FROM events WHERE value > 5 GROUP BY 1")
def engine_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, sf_dir).query("SELECT event_type, count(*) AS n FROM events WHERE value > :least GROUP BY 1", {"least": 5})


@query("engine_semantic")
def engine_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Engine(spark, sf_dir).query("SEMANTIC 'restore the shard' WHERE label < 5 LIMIT 8")
    return out.select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query("shard_placement", "SELECT count(*) AS nodes, count(DISTINCT coalesce(list_filter(string_split(file_path, '/'), lambda x: x <> '')[1], '_root')) AS packages FROM nodes WHERE file_path IS NOT NULL")
def shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nodes").filter("file_path is not null")
    placed = n.groupBy(R.package("file_path").alias("p"), S.shard_of("file_path").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    return placed.agg(F.sum("n").alias("nodes"), F.count_distinct("p").alias("packages"))


@query("quota_used", "SELECT source AS tenant, sum(strlen(text))::BIGINT AS bytes, 100000::BIGINT AS quota_bytes, sum(strlen(text)) > 100000 AS exceeded FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY 1")
def quota_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").filter("text is not null and source is not null").select(F.col("source").alias("tenant"), F.octet_length("text").cast("long").alias("bytes"))
    return S.quota_used(d, d.select("tenant").distinct().withColumn("quota_bytes", F.lit(100_000).cast("long")))


# Event windows, in batch form; the tests hold streams against them.


def _ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _utc(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@query("ev_tumbling", "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def ev_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _utc(T.tumbling(_ev(spark, sf_dir), width="6 hours"), "window_start")


@query("ev_sliding", """SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 1 HOUR AS window_start, event_type, count(*) AS n FROM events, range(2) t(k) GROUP BY 1, 2""")
def ev_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _utc(T.sliding(_ev(spark, sf_dir), width="2 hours", slide="1 hour"), "window_start")


@query("ev_session", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS f FROM events),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def ev_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _utc(T.sessions(_ev(spark, sf_dir), gap="2 hours"), "session_start", "session_end")
