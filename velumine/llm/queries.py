"""Queries of the corpus operators, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velumine.functions.text import key, level
from velumine.llm import clusters, functions_docs, knn, markup, packing, pieces, spans, tokens, vectors
from velumine.session import Workspace
from velumine.sources.tables import load

#: Capacity of a container in tokens.
CONTAINER = 2048


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return functions_docs.document_pairs(load(spark, sf_dir, "nodes"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_pairs(spark, sf_dir).select("node_id", "func_name")


#: Least cosine and size of clusters of nodes; least Jaccard similarity and size of clusters of chunks.
NODE_CLUSTER, CHUNK_CLUSTER = (0.7, 10), (0.6, 3)


def _node_clusters(spark: SparkSession, sf_dir: str, work: Workspace) -> clusters.VectorClusters:
    return clusters.VectorClusters(vectors.usable(load(spark, sf_dir, "nodes"), work, key("id"), "embedding"), work, NODE_CLUSTER[0])


def _chunk_clusters(spark: SparkSession, sf_dir: str, work: Workspace) -> clusters.WordClusters:
    paragraphs = load(spark, sf_dir, "chunks").filter(level("level") == "paragraph")
    return clusters.WordClusters(paragraphs.select(key("id").alias("_id"), F.col("text").alias("_text")), work, CHUNK_CLUSTER[0])


def _clustered(spark: SparkSession, sf_dir: str, work: Workspace) -> tuple[clusters.VectorClusters, clusters.WordClusters, clusters.Clusters]:
    """Nodes and chunks, and the clusters of both: two graphs that go through the same rounds."""
    nodes, chunks = _node_clusters(spark, sf_dir, work), _chunk_clusters(spark, sf_dir, work)
    edges = nodes.edges.withColumn("t", F.lit(0)).unionByName(chunks.edges.withColumn("t", F.lit(1)))
    return nodes, chunks, clusters.Clusters(edges, work)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, chunks, found = _clustered(spark, sf_dir, Workspace(spark, "p3"))
    nodes = nodes.members(NODE_CLUSTER[1], found.nodes.filter("t = 0")).select(F.lit("nodes").alias("table_name"), "item_id", "cluster_id")
    chunks = chunks.members(CHUNK_CLUSTER[1], found.nodes.filter("t = 1")).select(F.lit("chunks").alias("table_name"), "item_id", "cluster_id")
    return nodes.unionByName(chunks)


def p3_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cluster with its size and most typical members."""
    nodes, chunks, found = _clustered(spark, sf_dir, Workspace(spark, "p3c"))
    nodes = clusters.describe(nodes.affinity(nodes.members(NODE_CLUSTER[1], found.nodes.filter("t = 0"))))
    chunks = clusters.describe(chunks.members(CHUNK_CLUSTER[1], found.nodes.filter("t = 1")))
    return nodes.withColumn("table_name", F.lit("nodes")).unionByName(chunks.withColumn("table_name", F.lit("chunks")))


def p3_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many clusters of the embedding the exact check let stand, and how many it repaired."""
    found = _clustered(spark, sf_dir, Workspace(spark, "p3r"))[2].repairs()
    return found.select(F.when(F.col("t") == 0, "nodes").otherwise("chunks").alias("table_name"), "clusters", "failed")


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.pieces(load(spark, sf_dir, "documents"), load(spark, sf_dir, "chunks"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    forced = p4_pieces(spark, sf_dir).groupBy("table_name", "item_id").agg(F.max("forced").alias("_f"))
    return forced.select("table_name", "item_id", F.when(F.col("_f"), "forced").otherwise("natural").alias("kind"))


def p4_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, item_id, bytes, fits): what the pieces of each item cover without their overlaps, and whether all are within
    the limit and repeat at most the overlap."""
    rows = p4_pieces(spark, sf_dir)
    most = F.when(F.col("table_name") == "documents", 6000).otherwise(1200)
    size = F.col("end_offset") - F.col("start_offset")
    held = (size <= most) & (F.octet_length("text") == size) & (F.col("overlap") <= 200)
    return rows.groupBy("table_name", "item_id").agg(F.sum(size - F.col("overlap")).alias("bytes"), F.min(held).alias("fits"))


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.analyse_tables(load(spark, sf_dir, "documents"), load(spark, sf_dir, "chunks"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.kinds_found(load(spark, sf_dir, "documents"), load(spark, sf_dir, "chunks"))


def _indexes(spark: SparkSession, sf_dir: str) -> dict[str, knn.VectorIndex]:
    work = Workspace(spark, "p7")
    shard = F.concat(key("shard_id"), F.lit(":"), level("level"))
    return {
        "nodes": knn.VectorIndex(load(spark, sf_dir, "nodes"), work, key("id"), "embedding"),
        "vec_chunks": knn.VectorIndex(load(spark, sf_dir, "vec_chunks"), work, key("id"), "embedding"),
        "shard_centroids": knn.VectorIndex(load(spark, sf_dir, "shard_centroids"), work, shard, "centroid", scope=level("level")),
    }


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: The least cosine of a pair in p7_found.
ALIKE = 0.98


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for name, index in _indexes(spark, sf_dir).items():
        pairs = index.named(index.neighbours(index.rows, 10, floor=ALIKE), "a", "b")
        pairs = pairs.select(F.lit(name).alias("table_name"), F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
        parts.append(index.work.keep(pairs.distinct()))  # as one plan, the three took too much of the driver's memory
    return _union(parts)


def p7_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most similar vectors of the records whose hashed id is divisible by 50, searched among all."""
    parts = []
    for name, index in _indexes(spark, sf_dir).items():
        asked = index.rows if name == "shard_centroids" else index.rows.filter(F.pmod(F.xxhash64("_id"), F.lit(50)) == 0)
        found = index.named(index.neighbours(asked, 10)).select(F.lit(name).alias("table_name"), "id", "neighbour_id", F.round("similarity", 6).alias("similarity"))
        parts.append(index.work.keep(found))
    return _union(parts)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(load(spark, sf_dir, "documents"))


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, chars): the text that comes back from the ids of each document, by its length and digest."""
    back = tokens.decode(tokens.encode(load(spark, sf_dir, "documents")))
    return back.select("doc_id", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


def p8_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, bytes, chars, gaps): where the last token of each document ends; tokens that do not begin where the one before
    ends would be gaps."""
    rows = tokens.encode_with_offsets(load(spark, sf_dir, "documents"))
    size = F.col("end_byte") - F.col("start_byte")
    out = rows.groupBy("doc_id").agg(F.max("end_byte").cast("long").alias("bytes"), F.max("end_char").cast("long").alias("chars"), (F.max("end_byte") - F.sum(size)).cast("long").alias("gaps"))
    return out


def p9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "p9")
    sizes = work.keep(tokens.count_tokens(load(spark, sf_dir, "documents")))
    return packing.pack(sizes, "doc_id", "n_tokens", CONTAINER, work)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.SharedSpans(load(spark, sf_dir, "documents"), Workspace(spark, "p10")).pairs()


def p10_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.SharedSpans(load(spark, sf_dir, "documents"), Workspace(spark, "p10")).share()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p2_found": p2_found, "p2_pairs": p2_pairs, "p3_found": p3_found, "p3_clusters": p3_clusters, "p3_repairs": p3_repairs, "p4_found": p4_found, "p4_pieces": p4_pieces, "p4_cover": p4_cover, "p5_found": p5_found, "p5_clean": p5_clean, "p7_found": p7_found, "p7_knn": p7_knn, "p8_ids": p8_ids, "p8_round_trip": p8_round_trip, "p8_offsets": p8_offsets, "p9_pack": p9_pack, "p10_found": p10_found, "p10_share": p10_share}

_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+"
_RUN = f"list_max(list_transform(regexp_split_to_array(text, '{_SPACE}'), lambda w: strlen(w)))"
P4_SQL = f"""
SELECT table_name, item_id, CASE WHEN max(run) > max(most) THEN 'forced' ELSE 'natural' END AS kind FROM (
  SELECT 'documents' AS table_name, CAST(doc_id AS VARCHAR) AS item_id, {_RUN} AS run, 6000 AS most FROM documents WHERE strlen(text) > 6000
  UNION ALL
  SELECT 'chunks', trim(id), {_RUN}, 1200 FROM chunks WHERE strlen(text) > 1200 AND lower(trim(level)) IN ('paragraph', 'sentence')
) GROUP BY table_name, item_id
"""

_UNIT = """SELECT trim({id}) AS id, {scope} AS scope, any_value({v}::DOUBLE[]) AS v FROM {t}
WHERE len({v}) = 64 AND len(list_filter({v}, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter({v}, lambda x: x <> 0)) > 0 GROUP BY ALL"""
_PAIRS = "SELECT '{t}' AS table_name, a.id AS id_a, b.id AS id_b FROM {u} a JOIN {u} b ON a.id < b.id AND a.scope = b.scope WHERE list_cosine_similarity(a.v, b.v) >= 0.98"
P7_SQL = (
    f"WITH n AS ({_UNIT.format(id='id', scope="''", v='embedding', t='nodes')}), c AS ({_UNIT.format(id='id', scope="''", v='embedding', t='vec_chunks')}), "
    f"s AS ({_UNIT.format(id="shard_id) || ':' || lower(trim(level)", scope='lower(trim(level))', v='centroid', t='shard_centroids')}) "
    + " UNION ALL ".join(_PAIRS.format(t=t, u=u) for t, u in (("nodes", "n"), ("vec_chunks", "c"), ("shard_centroids", "s")))
)

P3_SQL = f"""
WITH RECURSIVE n AS ({_UNIT.format(id='id', scope="''", v='embedding', t='nodes')}),
w AS (SELECT DISTINCT trim(id) AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM chunks WHERE lower(trim(level)) = 'paragraph' AND text IS NOT NULL),
k AS (SELECT id, count(*) AS n FROM w GROUP BY 1 HAVING count(*) >= 20),
j AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM w a JOIN w b USING (word) WHERE a.id <> b.id AND a.id IN (SELECT id FROM k) AND b.id IN (SELECT id FROM k) GROUP BY 1, 2),
e AS MATERIALIZED (SELECT 'nodes' AS t, a.id AS a, b.id AS b FROM n a JOIN n b ON a.id <> b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.7
  UNION ALL SELECT 'chunks', j.a, j.b FROM j JOIN k x ON x.id = j.a JOIN k y ON y.id = j.b WHERE j.n >= 0.6::DOUBLE * (x.n + y.n - j.n) - 1e-9),
r AS (SELECT t, a, b FROM e UNION SELECT r.t, r.a, e.b FROM r JOIN e ON e.t = r.t AND e.a = r.b),
m AS (SELECT t, a, min(least(a, b)) AS c FROM r GROUP BY 1, 2), z AS (SELECT t, c, count(*) AS n FROM m GROUP BY 1, 2)
SELECT m.t AS table_name, m.a AS item_id, m.c AS cluster_id FROM m JOIN z USING (t, c) WHERE z.n >= CASE m.t WHEN 'nodes' THEN 10 ELSE 3 END
"""

P10_SQL = """
WITH g AS (SELECT DISTINCT doc_id, hash(substring(text, i::BIGINT, 150)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 148)) AS i FROM documents WHERE length(text) >= 150)),
s AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1), k AS (SELECT g.* FROM g JOIN s USING (h))
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM k a JOIN k b USING (h) WHERE a.doc_id < b.doc_id
"""

P10_SHARE_SQL = """
WITH g AS (SELECT doc_id, i, hash(substring(text, i::BIGINT, 150)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 148)) AS i FROM documents WHERE length(text) >= 150)),
s AS (SELECT h FROM g GROUP BY h HAVING count(DISTINCT doc_id) > 1), k AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM g WHERE h IN (SELECT h FROM s)),
c AS (SELECT doc_id, count(*) FILTER (b IS NULL OR i > b + 150)::INT AS n_spans, sum(CASE WHEN b IS NULL THEN 150 ELSE least(150, i - b) END)::INT AS shared_chars FROM k GROUP BY 1)
SELECT doc_id, n_spans, shared_chars, round(shared_chars / length(text)::DOUBLE, 6) AS share FROM c JOIN documents USING (doc_id)
"""

P4_COVER_SQL = """
SELECT 'documents' AS table_name, CAST(doc_id AS VARCHAR) AS item_id, strlen(text)::BIGINT AS bytes, true AS fits FROM documents WHERE strlen(text) > 6000
UNION ALL SELECT 'chunks', trim(id), max(strlen(text))::BIGINT, true FROM chunks WHERE strlen(text) > 1200 AND lower(trim(level)) IN ('paragraph', 'sentence') GROUP BY 2
"""
P8_ROUND_SQL = "SELECT doc_id, length(coalesce(text, '')) AS chars, md5(coalesce(text, '')) AS digest FROM documents"
P8_OFFSETS_SQL = "SELECT doc_id, strlen(text)::BIGINT AS bytes, length(text) AS chars, 0::BIGINT AS gaps FROM documents WHERE text <> ''"

ORACLES: dict[str, str] = {"p4_cover": P4_COVER_SQL, "p8_round_trip": P8_ROUND_SQL, "p8_offsets": P8_OFFSETS_SQL, "p10_share": P10_SHARE_SQL, "p3_found": P3_SQL, "p4_found": P4_SQL, "p7_found": P7_SQL, "p10_found": P10_SQL}
