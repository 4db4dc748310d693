"""Vector search, index and ranking queries over ``embeddings``, ``documents`` and ``events``."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velumine.functions import vector as V
from velumine.operators import indexes, ranking, search
from velumine.plans.registry import query
from velumine.session import spread
from velumine.sources.tables import load

_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_Q = "q AS (SELECT * FROM embeddings WHERE vec_id = 1)"
#: The reference time of scores that depend on it.
NOW = datetime(2024, 2, 1)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings")


def _query(spark: SparkSession, sf_dir: str, vec_id: int = 1) -> list[float]:
    return list(_vectors(spark, sf_dir).filter(F.col("vec_id") == vec_id).first()["embedding"])


def _shown(df: DataFrame, *cols: str) -> DataFrame:
    return df.select("vec_id", *cols, F.round("similarity", 6).alias("similarity"))


@query("knn_exact", f"WITH {_Q} SELECT e.vec_id, round({_COS}, 6) AS similarity FROM embeddings e, q ORDER BY {_COS} DESC, e.vec_id LIMIT 20")
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(search.knn(_vectors(spark, sf_dir), _query(spark, sf_dir), 20, id_col="vec_id"))


@query("knn_hybrid", f"WITH {_Q} SELECT e.vec_id, e.label, round({_COS}, 6) AS similarity FROM embeddings e, q WHERE e.label <> 3 ORDER BY {_COS} DESC, e.vec_id LIMIT 20")
def knn_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(search.knn(_vectors(spark, sf_dir), _query(spark, sf_dir), 20, id_col="vec_id", where="label <> 3"), "label")


@query("knn_floor", f"WITH {_Q} SELECT e.vec_id, round({_COS}, 6) AS similarity FROM embeddings e, q WHERE {_COS} >= 0.2 AND 1 - {_COS} < 0.75 ORDER BY {_COS} DESC, e.vec_id LIMIT 50")
def knn_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(search.knn(_vectors(spark, sf_dir), _query(spark, sf_dir), 50, id_col="vec_id", floor=0.2, ceiling=0.75))


@query("knn_batch", f"""WITH q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id < 20),
s AS (SELECT query_id, vec_id AS id, {_COS} AS sim FROM embeddings e, q WHERE vec_id <> query_id)
SELECT query_id, id, round(sim, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s
QUALIFY rank <= 5""")
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated queries, the first twenty vectors, against all."""
    df = _vectors(spark, sf_dir)
    queries = df.filter("vec_id < 20").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    out = search.knn_batch(df, queries, 5, id_col="vec_id")
    return out.withColumn("similarity", F.round("similarity", 6)).withColumn("rank", F.col("rank").cast("long"))


@query("knn_batch_50", f"""WITH q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id AS id, {_COS} AS sim FROM embeddings e, q WHERE vec_id <> query_id)
SELECT query_id, id, round(sim, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s
QUALIFY rank <= 5""")
def knn_batch_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50, against all."""
    df = _vectors(spark, sf_dir)
    queries = df.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    out = search.knn_batch(df, queries, 5, id_col="vec_id")
    return out.withColumn("similarity", F.round("similarity", 6)).withColumn("rank", F.col("rank").cast("long"))


@query("knn_within", f"WITH {_Q} SELECT e.vec_id, round({_COS}, 6) AS similarity FROM embeddings e, q WHERE e.label IN (2, 4) ORDER BY {_COS} DESC, e.vec_id LIMIT 10")
def knn_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _vectors(spark, sf_dir)
    return _shown(search.within(df, df.filter("label in (2, 4)").select("vec_id"), _query(spark, sf_dir), 10, id_col="vec_id"))


def _stage(source: str, dims: int, keep: int) -> str:
    c = f"list_cosine_similarity(list_slice(e.embedding, 1, {dims})::DOUBLE[], list_slice(q.embedding, 1, {dims})::DOUBLE[])"
    return f"(SELECT e.vec_id, e.embedding, {c} AS sim FROM {source} e, q ORDER BY {c} DESC, e.vec_id LIMIT {keep})"


@query("knn_cascade", f"WITH {_Q}, a AS {_stage('embeddings', 8, 500)}, b AS {_stage('a', 16, 100)}, c AS {_stage('b', 32, 30)}, d AS {_stage('c', 64, 10)} SELECT vec_id, round(sim, 4) AS similarity FROM d")
def knn_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.cascade(_vectors(spark, sf_dir), _query(spark, sf_dir), 10, (8, 16, 32, 64), factors={8: 50, 16: 10, 32: 3}, id_col="vec_id")
    return out.select("vec_id", "similarity")


@query("vec_distances", f"""WITH {_Q}, d AS (SELECT e.vec_id, list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS l2, list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS ip, {_COS} AS c FROM embeddings e, q)
SELECT vec_id, round(l2, 6) AS euclidean, round(l2 * l2, 6) AS squared, round(-ip, 6) + 0.0 AS dot_distance, round(1 / (1 + l2), 6) AS sim_l2, round(c, 6) AS sim_cosine FROM d""")
def vec_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, e = V.vec(_query(spark, sf_dir)), F.col("embedding")
    d = V.euclidean(e, q)
    return _vectors(spark, sf_dir).select(
        "vec_id", F.round(d, 6).alias("euclidean"), F.round(V.squared_euclidean(e, q), 6).alias("squared"), (F.round(V.distance(e, q, "dot"), 6) + 0.0).alias("dot_distance"),
        F.round(V.similarity_of(d, "euclidean"), 6).alias("sim_l2"), F.round(V.similarity_of(V.distance(e, q)), 6).alias("sim_cosine"),
    )


_CENTROIDS = """x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS p FROM embeddings),
m AS (SELECT label, p, avg(v) AS v, count(*) AS n FROM x GROUP BY label, p),
c AS (SELECT label, list(v ORDER BY p) AS centroid, max(n) AS n, sqrt(sum(v * v)) AS nrm FROM m GROUP BY label)"""


@query("centroids", f"WITH {_CENTROIDS} SELECT label, list_transform(centroid, lambda v: round(v, 6)) AS centroid, n, round(nrm, 6) AS centroid_norm FROM c")
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.centroids(_vectors(spark, sf_dir), "label")
    return out.select("label", F.transform("centroid", lambda v: F.round(v, 6)).alias("centroid"), "n", F.round("centroid_norm", 6).alias("centroid_norm"))


@query("shard_route", f"""WITH {_CENTROIDS}, {_Q}, r AS (SELECT c.label FROM c, q ORDER BY list_cosine_similarity(c.centroid, q.embedding::DOUBLE[]) DESC, c.label LIMIT 3)
SELECT e.vec_id, e.label, round({_COS}, 6) AS similarity FROM embeddings e JOIN r USING (label), q ORDER BY {_COS} DESC, e.vec_id LIMIT 20""")
def shard_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _vectors(spark, sf_dir)
    return _shown(search.routed_knn(df, search.centroids(df, "label"), _query(spark, sf_dir), 20, 3, key="label", id_col="vec_id"), "label")


@query("bloom_route")
def bloom_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each source's filter may hold two terms."""
    docs = load(spark, sf_dir, "documents").filter("text is not null and source is not null")
    words = docs.select("source", F.explode(ranking.terms_of(F.col("text"))).alias("term"))
    filters = search.bloom_build(words, "source", "term", size=100_000)
    return filters.select("source", F.size("bloom").alias("set_positions"), search.may_hold(F.col("bloom"), "shard", size=100_000).alias("may_hold_shard"), search.may_hold(F.col("bloom"), "no-such-term", size=100_000).alias("may_hold_other"))


def _bits(v: str, dims: int) -> str:
    return f"list_transform(range(1, {dims + 1}), lambda i: CASE WHEN {v}[i] >= 0 THEN 1 ELSE 0 END)"


@query("binary_hamming", f"""WITH {_Q}, h AS (SELECT e.vec_id, list_sum(list_transform(list_zip({_bits('e.embedding', 64)}, {_bits('q.embedding', 64)}), lambda z: abs(z[1] - z[2])))::INT AS hamming FROM embeddings e, q)
SELECT vec_id, hamming, round(1 - hamming / 64.0::DOUBLE, 6) AS similarity FROM h ORDER BY hamming, vec_id LIMIT 20""")
def binary_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(indexes.create("binary", id_col="vec_id").fit(_vectors(spark, sf_dir)).search(_query(spark, sf_dir), 20), "hamming")


_CELL = "list_transform(range(0, 64, 8), lambda i: floor((list_sum(list_slice({v}::DOUBLE[], i + 1, i + 8)) / 8 - list_min({v}::DOUBLE[])) / (list_max({v}::DOUBLE[]) - list_min({v}::DOUBLE[])) * 15)::INT)"


@query("cell_search", f"""WITH {_Q}, k AS (SELECT e.vec_id, e.embedding, {_CELL.format(v='e.embedding')} AS a, {_CELL.format(v='q.embedding')} AS b FROM embeddings e, q)
SELECT e.vec_id, round({_COS}, 6) AS similarity FROM k e, q WHERE list_max(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))) <= 3 ORDER BY {_COS} DESC, e.vec_id LIMIT 10""")
def cell_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(indexes.create("quantized", id_col="vec_id", radius=3).fit(_vectors(spark, sf_dir)).search(_query(spark, sf_dir), 10))


def _recall(spark: SparkSession, sf_dir: str, name: str, **options) -> DataFrame:
    df, q = _vectors(spark, sf_dir), _query(spark, sf_dir)
    found = indexes.create(name, id_col="vec_id", **options).fit(df).search(q, 10)
    truth = search.knn(df, q, 10, id_col="vec_id").select("vec_id", F.lit(True).alias("true_neighbour"))
    return found.join(truth, "vec_id", "left").select("vec_id", F.round("similarity", 6).alias("similarity"), F.coalesce("true_neighbour", F.lit(False)).alias("true_neighbour"))


@query("ivf_search")
def ivf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recall(spark, sf_dir, "ivf", n_lists=16, n_probe=8)


@query("pq_search")
def pq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recall(spark, sf_dir, "pq", m=8, k_sub=64)


# Three scores per vector: similarity to the query, a rank-like number and the age of the event of the same number.
_SCORED = f"""{_Q}, s AS (SELECT e.vec_id, greatest(0.0, {_COS}) AS s_vector, least(1.0, e.label * 12.5 / 100.0)::DOUBLE AS s_pagerank,
  CASE WHEN v.ts IS NULL THEN 0.5 ELSE pow(0.5::DOUBLE, date_sub('day', v.ts, TIMESTAMP '2024-02-01') / 30.0) END AS s_fresh
  FROM embeddings e CROSS JOIN q LEFT JOIN events v ON v.event_id = e.vec_id)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = search.by_vector(_vectors(spark, sf_dir), _query(spark, sf_dir))
    ts = load(spark, sf_dir, "events").select(F.col("event_id").alias("vec_id"), "ts")
    now = F.lit(NOW).cast("timestamp_ntz")
    return df.join(ts, "vec_id", "left").select(
        "vec_id", ranking.vector_score(F.col("similarity")).alias("s_vector"), ranking.pagerank_score(F.col("label") * 12.5).alias("s_pagerank"), ranking.freshness_score(F.col("ts"), now).alias("s_fresh")
    )


@query("rank_weighted", f"WITH {_SCORED} SELECT vec_id, round(0.6 * s_vector + 0.2 * s_pagerank + 0.1 * s_fresh, 6) AS score FROM s")
def rank_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = {"vector": F.col("s_vector"), "pagerank": F.col("s_pagerank"), "freshness": F.col("s_fresh")}
    return _scored(spark, sf_dir).select("vec_id", F.round(ranking.weighted_sum(cols, ranking.WEIGHTS), 6).alias("score"))


@query("rank_max", f"WITH {_SCORED} SELECT vec_id, round(greatest(s_vector, s_pagerank, s_fresh), 6) AS score FROM s")
def rank_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("vec_id", F.round(ranking.max_score({c: F.col(c) for c in ("s_vector", "s_pagerank", "s_fresh")}), 6).alias("score"))


@query("rank_rrf", f"""WITH {_SCORED} SELECT vec_id, round(1.0 / (60 + row_number() OVER (ORDER BY s_vector DESC, vec_id)) + 1.0 / (60 + row_number() OVER (ORDER BY s_pagerank DESC, vec_id))
  + 1.0 / (60 + row_number() OVER (ORDER BY s_fresh DESC, vec_id)), 8)::DOUBLE AS score FROM s""")
def rank_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranking.reciprocal_rank_fusion(_scored(spark, sf_dir), ["s_vector", "s_pagerank", "s_fresh"], "vec_id")
    return out.select("vec_id", F.round("rrf", 8).alias("score"))


@query("rank_pipeline", f"WITH {_SCORED} SELECT vec_id, round(0.6 * s_vector + 0.2 * s_pagerank, 6) AS score FROM s WHERE 0.6 * s_vector + 0.2 * s_pagerank >= 0.1")
def rank_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranker = ranking.Ranker({"vector": lambda d: d["s_vector"], "pagerank": lambda d: d["s_pagerank"]}, min_score=0.1)
    return ranker.rank(_scored(spark, sf_dir), "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query("text_match", "SELECT doc_id, (CASE WHEN lower(text) LIKE '%shard%' THEN 1 ELSE 0 END + CASE WHEN lower(text) LIKE '%ranking%' THEN 1 ELSE 0 END) / 2.0::DOUBLE AS score FROM documents WHERE text IS NOT NULL")
def text_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").filter("text is not null")
    return docs.select("doc_id", ranking.text_match_score(F.col("text"), ["Shard", "ranking"]).alias("score"))


@query("keyword_or", "SELECT doc_id FROM documents WHERE lower(text) LIKE '%crater%' OR lower(text) LIKE '%tensor%'")
def keyword_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").filter(F.col("text").ilike("%crater%") | F.col("text").ilike("%tensor%")).select("doc_id")


_TERM_SPLIT = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-zA-Z0-9_]+'), lambda x: length(x) > 2)"


@query("terms", f"SELECT doc_id, length({_TERM_SPLIT})::INT AS n_terms, length(list_distinct({_TERM_SPLIT}))::INT AS n_distinct FROM documents")
def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ranking.terms_of(F.coalesce("text", F.lit("")))
    return spread(load(spark, sf_dir, "documents")).select("doc_id", F.size(t).alias("n_terms"), F.size(F.array_distinct(t)).alias("n_distinct"))


@query("bm25", f"""WITH w AS (SELECT doc_id, {_TERM_SPLIT} AS t FROM documents),
c AS (SELECT doc_id, length(t) AS len, length(list_filter(t, lambda x: x = 'crater')) AS a, length(list_filter(t, lambda x: x = 'tensor')) AS b FROM w),
s AS (SELECT count(*) AS n, avg(len) AS av, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c)
SELECT doc_id, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * len / av)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * len / av)), 6) AS bm25
FROM c, s WHERE a > 0 OR b > 0""")
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.bm25(spread(load(spark, sf_dir, "documents")), ["crater", "tensor"]).select("doc_id", F.round("bm25", 6).alias("bm25"))
