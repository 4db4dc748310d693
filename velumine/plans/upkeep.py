"""Queries that write, change, search again or keep account: ingestion, indexes, handles, caches, triggers, pipelines."""

from __future__ import annotations

from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velumine.operators import chunking, evaluation, indexes, ingest, memory, ranking, retrieval, search
from velumine.operators import relational as R
from velumine.operators import state as S
from velumine.operators.code import imports, qualified_calls, references
from velumine.operators.graph import write_subgraph
from velumine.plans.engine import classify
from velumine.plans.graph import _G, _LINES, _graph, _once
from velumine.plans.registry import query
from velumine.plans.search import _CELL, _COS, _Q, _SCORED, _query, _scored, _shown, _vectors
from velumine.plans.state import _MEM, _memories
from velumine.plans.texts import _CLEAN, _PARA, _SENT, _asked, _chunks, _docs, _embedded
from velumine.session import Workspace, checkpoint_root
from velumine.sources import readers
from velumine.sources.tables import load

_T0 = datetime(2026, 1, 1)


def _at(seconds: int = 0) -> datetime:
    return _T0 + timedelta(seconds=seconds)


# ------------------------------------------------------------------------------------------------- files and documents


@query("scan_rows", "SELECT count(*) AS rows FROM documents")
def scan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.scan_status(load(spark, sf_dir, "documents")).agg(F.sum("rows").alias("rows"))


@query("shards_written", "SELECT (doc_id % 8)::INT AS shard_id, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents WHERE doc_id % 8 < 4 GROUP BY 1")
def shards_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written by shard; half of the shards are read back, by their folders."""
    path = f"{Workspace(spark, 'shards').root}/table"
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", F.pmod("doc_id", F.lit(8)).cast("int").alias("shard_id"))
    readers.write_shards(docs, path)
    back = spark.read.parquet(path).filter("shard_id < 4")
    return back.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


def _files(spark: SparkSession, name: str) -> str:
    """A folder with two texts, one of them no UTF-8, and a DOCX file."""
    root = Workspace(spark, name).root
    fs = readers.Storage(spark, root)
    jvm = spark.sparkContext._jvm
    import io
    import zipfile

    docx = io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>Two </w:t><w:t xml:space='preserve'>words</w:t></w:p>")
    for key, raw in (("in/a.txt", "Ein Text über Daten".encode()), ("in/b.txt", b"\xff\xfe broken"), ("in/c.docx", docx.getvalue())):
        out = fs._fs.create(jvm.org.apache.hadoop.fs.Path(f"{root}/{key}"), True)
        out.write(bytearray(raw))
        out.close()
    return root


@query("batch_status", "SELECT * FROM (VALUES ('a.txt', 'ok', 'Ein Text über Daten', NULL), ('b.txt', 'error', NULL, 'not UTF-8'), ('none.txt', 'error', NULL, 'not found')) t(name, status, text, error)")
def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _files(spark, "batch")
    got = readers.read_batch(spark, [f"{root}/in/{n}" for n in ("a.txt", "b.txt", "none.txt")])
    return got.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "status", "text", "error")


@query("prefix_status", "SELECT * FROM (VALUES ('error', 1::BIGINT), ('ok', 1::BIGINT)) t(status, n)")
def prefix_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.read_prefix(spark, f"{_files(spark, 'prefix')}/in").filter("path like '%.txt'")
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("docx_read", "SELECT 'Two words' AS text")
def docx_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_docx(spark, f"{_files(spark, 'docx')}/in/*.docx").select("text")


@query("text_read", "SELECT 'Ein Text über Daten' AS text, 20::INT AS bytes, 1::INT AS lines")
def text_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_text(spark, f"{_files(spark, 'text')}/in/a.txt").select("text", "bytes", "lines")


@query("binary_kinds", "SELECT * FROM (VALUES ('file', 3::BIGINT)) t(kind, n)")
def binary_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_binary(spark, f"{_files(spark, 'kinds')}/in/*").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("storage_listed", "SELECT * FROM (VALUES ('a.txt', true), ('c.docx', true), ('b.txt', false)) t(name, there)")
def storage_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    fs = readers.Storage(spark, _files(spark, "storage"))
    fs.delete("in/b.txt")
    listed = set(fs.list("in"))
    return spark.createDataFrame([(n, fs.exists(f"in/{n}") and n in listed) for n in ("a.txt", "b.txt", "c.docx")], "name string, there boolean")


@query("documents_indexed", f"""WITH q AS (SELECT doc_id, unnest({_PARA}) AS x FROM documents WHERE text <> ''), s AS (SELECT length({_SENT.replace('{t}', 'x')}) AS n FROM q)
SELECT 'document' AS level, count(*) AS n, 64::BIGINT AS dims FROM documents WHERE text <> '' UNION ALL SELECT 'paragraph', count(*), 64 FROM q UNION ALL SELECT 'sentence', sum(n)::BIGINT, 64 FROM s""")
def documents_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of three levels, each with a vector."""
    c = ingest.index_documents(_docs(spark, sf_dir))
    return c.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).cast("long").alias("dims"))


_SHARD = "d AS (SELECT doc_id, text, created_at, CASE WHEN doc_id % 10 < 4 THEN 0 ELSE doc_id % 10 END::INT AS shard_id FROM documents)"


def _sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    shard = F.when(F.col("doc_id") % 10 < 4, 0).otherwise(F.col("doc_id") % 10).cast("int")
    return load(spark, sf_dir, "documents").select("doc_id", "text", "created_at", shard.alias("shard_id"))


@query("shard_registry", f"""WITH {_SHARD}, h AS (SELECT shard_id, count(*) AS documents, coalesce(sum(strlen(text)), 0)::BIGINT AS bytes, max(created_at) AS latest FROM d GROUP BY 1)
SELECT *, round(bytes / (SELECT avg(bytes) FROM h), 4) AS load FROM h""")
def shard_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.shard_registry(_sharded(spark, sf_dir))


@query("shard_rebalanced", f"WITH {_SHARD} SELECT count(*) AS documents, 9::BIGINT AS shards, 0::BIGINT AS crowded FROM d")
def shard_rebalanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shard of four tenths of the documents is divided; none is left that holds more than 1.5 times the mean."""
    counts = ingest.rebalanced(_sharded(spark, sf_dir)).groupBy("shard_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.sum("n").alias("documents"), F.count(F.lit(1)).alias("shards"), F.count_if(F.col("n") > 0.2 * F.lit(load(spark, sf_dir, "documents").count())).alias("crowded"))


@query("documents_deleted", "SELECT doc_id FROM documents WHERE doc_id % 7 <> 0")
def documents_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    none = d.limit(0).select(F.col("doc_id").cast("string").alias("doc_id"))
    return ingest.delete_documents(d, none, d.filter("doc_id % 7 = 0"))[0].select("doc_id")


@query("documents_upserted", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'again' ELSE source END AS source FROM documents")
def documents_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select("doc_id", "source")
    return readers.upsert(d, d.filter("doc_id % 10 = 0").withColumn("source", F.lit("again")), "doc_id")


_BASE = "b AS (SELECT id, type FROM nn WHERE type IN ('module', 'class')), w AS (SELECT id, 'again' AS type FROM nn WHERE type IN ('class', 'function')), o AS (SELECT * FROM w UNION ALL SELECT * FROM b WHERE id NOT IN (SELECT id FROM w))"


@query("subgraph_written", f"""WITH {_G}, {_BASE} SELECT 'node' AS kind, type, count(*) AS n FROM o GROUP BY 2
UNION ALL SELECT 'edge', type, count(*) FROM e WHERE source_id IN (SELECT id FROM o) AND target_id IN (SELECT id FROM o) GROUP BY 2""")
def subgraph_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules and classes, with classes and functions written over them; edges that dangle are left out."""
    g = _graph(spark, sf_dir)
    base = g.nodes.filter("type in ('module', 'class')").select("id", "type")
    new = g.nodes.filter("type in ('class', 'function')").select("id", F.lit("again").alias("type"))
    edges = g.edges.select("source_id", "target_id", "type")
    n, e = write_subgraph(base, edges.limit(0), new, edges)
    count = lambda d, k: d.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "type", "n")
    return count(n, "node").unionByName(count(e, "edge"))


@query("source_graph", "SELECT * FROM (VALUES ('calls', 'EXTRACTED', 1::BIGINT), ('calls', 'INFERRED', 2::BIGINT), ('contains', 'EXTRACTED', 3::BIGINT)) t(type, confidence, n)")
def source_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two source files to a graph of their symbols."""
    files = [("lib/a.ex", "defmodule A do\n  def run(x) do\n    helper(x)\n    other(x)\n  end\n\n  def helper(x), do: x\nend\n"), ("b.py", "class B:\n    def go(self):\n        step(1)\n# def no(): pass\n")]
    edges = ingest.source_files(spark.createDataFrame(files, "path string, text string"))[1]
    return edges.groupBy("type", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query("code_imports", f"""WITH {_LINES.replace('{lang}', 'elixir')}, m AS (SELECT unit, regexp_extract(s, '^\\s*(?:alias|import|use|require)\\s+([A-Z][\\w.]*)', 1) AS name FROM k)
SELECT DISTINCT unit AS source_id, 'module:' || name AS target_id, 'imports' AS type, 'EXTRACTED' AS confidence FROM m WHERE name <> ''""")
def code_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports(_once(spark, sf_dir), "elixir")


@query("code_qualified", f"""WITH {_LINES.replace('{lang}', 'elixir')}, m AS (SELECT unit, line, unnest(regexp_extract_all(s, '([A-Z][A-Za-z0-9_.]*\\.[a-z_][A-Za-z0-9_?!]*)\\(', 1)) AS q FROM k)
SELECT DISTINCT unit, regexp_replace(q, '\\.[^.]*$', '') AS module, regexp_extract(q, '\\.([^.]*)$', 1) AS function, line FROM m""")
def code_qualified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qualified_calls(_once(spark, sf_dir), "elixir")


@query("code_references", f"""WITH {_LINES.replace('{lang}', 'python')}, u AS (SELECT unit, unnest(regexp_extract_all(' ' || s, '[^\\w.:@"'']([A-Z]\\w*(?:\\.[A-Z]\\w*)*)', 1)) AS name
  FROM k WHERE NOT regexp_matches(s, '^\\s*class\\s+[A-Za-z_]') AND NOT regexp_matches(s, '^\\s*(?:from\\s+[\\w.]+\\s+import|import\\s+[\\w.]+)'))
SELECT DISTINCT unit AS source_id, 'module:' || name AS target_id, 'references' AS type, 'INFERRED' AS confidence FROM u""")
def code_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references(_once(spark, sf_dir), "python")


@query("edge_filters", "SELECT DISTINCT lower(trim(type)) AS type, true AS holds FROM edges WHERE type IS NOT NULL AND (trim(source_id) <> '' OR trim(target_id) <> '')")
def edge_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter per type of edge holds every end of its edges."""
    e = load(spark, sf_dir, "edges").select(F.lower(F.trim("type")).alias("type"), "source_id", "target_id").filter("type is not null")
    return search.all_held(ingest.edge_ends(e), ingest.edge_blooms(e), "type", "_e", 100_000, 7)


@query("bloom_sound", "SELECT DISTINCT source, true AS holds FROM documents WHERE source IS NOT NULL AND text IS NOT NULL AND regexp_matches(text, '\\w{3}')")
def bloom_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No source's filter denies a term that the source holds."""
    docs = load(spark, sf_dir, "documents").filter("text is not null and source is not null")
    words = docs.select("source", F.explode(ranking.terms_of(F.col("text"))).alias("term")).distinct()
    held = search.bloom_build(words, "source", "term", size=100_000).select("source", F.explode("bloom").alias("_p"), F.lit(True).alias("_set"))
    asked = words.select("source", F.explode(search.bloom_positions(F.lower("term"), 100_000)).alias("_p")).distinct()
    return asked.join(held, ["source", "_p"], "left").groupBy("source").agg(F.min(F.coalesce("_set", F.lit(False))).alias("holds"))


# ------------------------------------------------------------------------------------------------- indexes


@query("index_changed", f"WITH {_Q} SELECT e.vec_id, round({_COS}, 6) AS similarity FROM embeddings e, q WHERE e.vec_id % 5 <> 0 ORDER BY {_COS} DESC, e.vec_id LIMIT 10")
def index_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of even id, then those of odd id added, then those divisible by five removed."""
    df = _vectors(spark, sf_dir)
    index = indexes.create("exact", id_col="vec_id").fit(df.filter("vec_id % 2 = 0")).add(df.filter("vec_id % 2 = 1")).delete(df.filter("vec_id % 5 = 0"))
    return _shown(index.search(_query(spark, sf_dir), 10))


@query("index_stats", "SELECT count(*) AS vectors FROM embeddings")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.create("exact", id_col="vec_id").fit(_vectors(spark, sf_dir)).stats()


@query("index_migrated", f"""WITH {_Q}, k AS (SELECT e.vec_id, e.embedding, {_CELL.format(v='e.embedding')} AS a, {_CELL.format(v='q.embedding')} AS b FROM embeddings e, q)
SELECT e.vec_id, round({_COS}, 6) AS similarity FROM k e, q WHERE list_max(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))) <= 3 ORDER BY {_COS} DESC, e.vec_id LIMIT 10""")
def index_migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exact index saved, loaded, moved to quantised cells, and searched after the switch."""
    path = f"{Workspace(spark, 'index').root}/saved"
    indexes.create("exact", id_col="vec_id").fit(_vectors(spark, sf_dir)).save(path)
    old = indexes.load(spark, path)
    return _shown(indexes.Switch(old).to(indexes.migrate(old, "quantized", radius=3)).search(_query(spark, sf_dir), 10))


def _recall_50(spark: SparkSession, sf_dir: str, name: str, **options) -> DataFrame:
    """Recall of the ten nearest for every vector whose id is divisible by 50, against all."""
    df = _vectors(spark, sf_dir)
    asked = df.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = indexes.create(name, id_col="vec_id", **options).fit(df).search_batch(asked, 10).select("query_id", "id", F.lit(1).alias("hit"))
    met = search.knn_batch(df, asked, 10, id_col="vec_id").join(found, ["query_id", "id"], "left")
    return met.agg(F.lit(name).alias("strategy"), F.count_distinct("query_id").alias("queries"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("enough"))


@query("hnsw_recall", "SELECT 'hnsw' AS strategy, count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 50 = 0")
def hnsw_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recall_50(spark, sf_dir, "hnsw")


@query("ivf_recall", "SELECT 'ivf' AS strategy, count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 50 = 0")
def ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recall_50(spark, sf_dir, "ivf", n_lists=16, n_probe=12)


@query("pq_recall", "SELECT 'pq' AS strategy, count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 50 = 0")
def pq_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recall_50(spark, sf_dir, "pq", m=16, k_sub=64)


@query("hnsw_search", f"WITH {_Q} SELECT e.vec_id, round({_COS}, 6) AS similarity FROM embeddings e, q ORDER BY {_COS} DESC, e.vec_id LIMIT 1")
def hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector asked for finds itself."""
    return _shown(indexes.create("hnsw", id_col="vec_id").fit(_vectors(spark, sf_dir)).search(_query(spark, sf_dir), 1))


@query("binary_mean", f"""WITH {_Q}, m AS (SELECT p, avg(v) AS t FROM (SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS p FROM embeddings) GROUP BY p), t AS (SELECT list(t ORDER BY p) AS t FROM m),
h AS (SELECT e.vec_id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (e.embedding[i] >= t.t[i]) = (q.embedding[i] >= t.t[i]) THEN 0 ELSE 1 END))::INT AS hamming FROM embeddings e, q, t)
SELECT vec_id, hamming, round(1 - hamming / 64.0::DOUBLE, 6) AS similarity FROM h ORDER BY hamming, vec_id LIMIT 20""")
def binary_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(indexes.create("binary", id_col="vec_id", thresholds="mean").fit(_vectors(spark, sf_dir)).search(_query(spark, sf_dir), 20), "hamming")


@query("index_recommended", "SELECT * FROM (VALUES (100::BIGINT, false, 'exact'), (20000, false, 'ivf'), (20000, true, 'pq')) t(vectors, tight, strategy)")
def index_recommended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, t, indexes.recommend(n, t)) for n, t in ((100, False), (20_000, False), (20_000, True))], "vectors long, tight boolean, strategy string")


@query("centroids_sampled", "SELECT label, least(100, count(*)) AS n FROM embeddings GROUP BY 1")
def centroids_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.sampled_centroid(_vectors(spark, sf_dir), "label").select("label", "n")


# ------------------------------------------------------------------------------------------------- handles, caches, triggers


@query("handle_page", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 20 OFFSET 100")
def handle_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = S.Handles(spark)
    h.store("events", load(spark, sf_dir, "events").select("event_id", "event_type"), ["event_id"])
    return h.expand("events", 100, 20)


@query("handle_search", "SELECT * FROM (VALUES ('words', 'regions', 5::BIGINT, 1::BIGINT), ('part of a word', 'nations', 25::BIGINT, 0::BIGINT), ('in a preview', 'regions', 5::BIGINT, 1::BIGINT)) t(asked, name, n, rank)")
def handle_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the words of a name, by a part of one, and by a word of a preview; an expired handle is not found."""
    h = S.Handles(spark)
    h.store("regions", load(spark, sf_dir, "region").select("r_name"), ["r_name"])
    h.store("nations", load(spark, sf_dir, "nation").select("n_name"), ["n_name"])
    h.store("regions of old", load(spark, sf_dir, "region").select("r_name"), ["r_name"], ttl_seconds=60, created_at=datetime(2020, 1, 1))
    out = None
    for asked, text in (("words", "Regions"), ("part of a word", "nation"), ("in a preview", "africa")):
        rows = h.search(text).select(F.lit(asked).alias("asked"), "name", "n", F.least("rank", F.lit(1)).cast("long").alias("rank"))
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


@query("rag_sources", f"""WITH {_CLEAN}, v AS (SELECT trim(id) AS id, any_value(embedding) AS embedding FROM vec_chunks WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 GROUP BY 1),
r AS (SELECT k.id, v.embedding FROM k JOIN v USING (id) WHERE k.text IS NOT NULL), q AS (SELECT embedding FROM r ORDER BY id LIMIT 1),
s AS (SELECT e.id, {_COS} AS sim FROM r e, q) SELECT id, round(sim, 6) AS similarity FROM s WHERE NOT isnan(sim) AND sim >= 0.3 ORDER BY sim DESC, id LIMIT 5""")
def rag_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _embedded(spark, sf_dir)
    return retrieval.find(rows, _asked(rows), Workspace(spark, "rag"), terms=["tensor"]).select("id", F.round("similarity", 6).alias("similarity"))


@query("rag_expanded", f"""WITH {_CLEAN}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, level ORDER BY start_offset, id) AS n FROM k),
h AS (SELECT * FROM o WHERE level = 'paragraph' AND text LIKE '%tensor%' ORDER BY id LIMIT 5)
SELECT h.id, string_agg(b.text, chr(10) ORDER BY b.n) AS text FROM h JOIN o b ON b.doc_id = h.doc_id AND b.level = h.level AND abs(b.n - h.n) <= 1 WHERE b.text IS NOT NULL GROUP BY 1""")
def rag_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits between their neighbours."""
    c = _chunks(spark, sf_dir)
    hits = c.filter("level = 'paragraph' and text like '%tensor%'").orderBy("id").limit(5).select("id", "text")
    return retrieval.expand(hits, c).select("id", "text")


@query("rag_compressed", "SELECT '$rag_restore_the_shard: Array(5)' AS stub UNION ALL SELECT '$rag_empty: Array(0)'")
def rag_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, h = _embedded(spark, sf_dir), S.Handles(spark)
    hits = retrieval.find(rows, _asked(rows), Workspace(spark, "rag"), floor=-1.0).select("id", "similarity")
    stubs = [retrieval.compressed(h, "Restore the shard!", hits), retrieval.compressed(h, "none", hits.limit(0))]
    return spark.createDataFrame([(s.split(")")[0] + ")",) for s in stubs], "stub string")


@query("cache_evicted", "SELECT vec_id AS cache_key FROM embeddings ORDER BY vec_id DESC LIMIT 100")
def cache_evicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir).select(F.col("vec_id").alias("cache_key"), F.expr("timestampadd(SECOND, vec_id, timestamp_ntz'2026-01-01')").alias("created_at"))
    return S.cache_evict(e, 100).select("cache_key")


@query("cache_through", "SELECT 'events' AS query, count(*) AS rows, 2::BIGINT AS made, 1::BIGINT AS hits FROM events")
def cache_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result is made once per query and options until it expires, and read again in between."""
    cache, made = S.ResultCache(spark), []

    def make() -> DataFrame:
        made.append(1)
        return load(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("rows"))

    for now, level in ((0, 1), (10, 1), (4000, 1)):
        out = cache.through("events", make, 3600, _at(now), level=level)
    return out.select(F.lit("events").alias("query"), "rows", F.lit(len(made)).cast("long").alias("made"), F.lit(cache.cache.hits).cast("long").alias("hits"))


@query("embedding_cache", "SELECT 3::BIGINT AS embedded, 5::BIGINT AS vectors")
def embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked: list[str] = []
    cache = S.EmbeddingCache(lambda texts: [asked.append(t) or [float(len(t))] for t in texts])
    n = len(cache(["a", "b", "a"])) + len(cache(["b", "c"]))
    return spark.createDataFrame([(len(asked), n)], "embedded long, vectors long")


@query("triggers_changed", "SELECT * FROM (VALUES ('t1', true, 1::BIGINT), ('t2', false, 0::BIGINT)) t(trigger_id, active, fire_count)")
def triggers_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three triggers made, one switched off and one deleted; the active ones are held against all vectors."""
    q = _query(spark, sf_dir)
    t = S.Triggers.empty(spark)
    for k in (1, 2, 3):
        t = t.create(f"trigger {k}", q, "https://example.org/hook", 0.99, created_at=_at(k), trigger_id=f"t{k}")
    t = t.enable("t2", False).delete("t3")
    docs = _vectors(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), "embedding")
    t = t.fired(S.match_triggers(docs, t.df), F.lit(_T0).cast("timestamp_ntz"))
    return t.df.select("trigger_id", "active", "fire_count")


@query("triggers_delivered", "SELECT * FROM (VALUES ('bad', 2::BIGINT, false, 3::INT), ('good', 3::BIGINT, true, 1::INT)) t(trigger_id, documents, delivered, attempts)")
def triggers_delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("good", "ok", i) for i in range(3)] + [("bad", "raise", i) for i in range(2)]

    def send(message: dict) -> bool:
        if message["target"] == "raise":
            raise OSError("no answer")
        return True

    out = S.deliver(spark.createDataFrame(rows, "trigger_id string, target string, doc_id long"), send)
    return out.select("trigger_id", "documents", "delivered", "attempts")


@query("prompts_active", "SELECT * FROM (VALUES ('ask', 2::INT, 'Say {{x}}', 3::INT, 3::BIGINT), ('tell', 1::INT, 'Tell', 1::INT, 1::BIGINT)) t(name, version, template, latest, versions)")
def prompts_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = spark.createDataFrame([], "name string, version int, template string, is_active boolean")
    p = S.Prompts(empty).store("ask", "Ask").store("ask", "Say {{x}}").store("ask", "Shout {{x}}").store("tell", "Tell").store("gone", "-").delete("gone").rollback("ask", 2)
    return p.active()


@query("pipeline_recorded", "SELECT 'find' AS name, 2::INT AS version, 2::INT AS steps, count(*) AS rows FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT 'find', 1, 1, count(*) FROM embeddings")
def pipeline_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 2 == 0, 0.9).otherwise(0.1).alias("similarity"))
    work, now = Workspace(spark, "pipe"), F.lit(_T0).cast("timestamp_ntz")
    p = S.Pipeline("find", [("deduplicate", {})])
    history = spark.createDataFrame([], S.HISTORY)
    for q in (p, p.redefine([("deduplicate", {}), ("filter", {"min_relevance": 0.5})])):
        history = q.recorded(df, history, work, now)[1]
    return history.drop("at")


@query("pipeline_dry", "SELECT * FROM (VALUES (0::INT, 'filter', 'min_relevance'), (1::INT, 'limit', 'by, count')) t(place, step, options)")
def pipeline_dry(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.Pipeline("find", [("filter", {"min_relevance": 0.5}), ("limit", {"count": 3, "by": "similarity"})])
    return p.run(_vectors(spark, sf_dir), dry=True)


@query("pipeline_walk", f"""WITH {_G}, h AS (SELECT id, (length(id) % 10) / 10.0::DOUBLE AS sim FROM nn WHERE type = 'module'), t AS (SELECT h.id, e.target_id AS related_id FROM h JOIN e ON e.source_id = h.id AND e.type = 'contains'),
x AS (SELECT h.id, e.target_id AS related_id FROM h LEFT JOIN e ON e.source_id = h.id) SELECT 'traverse' AS step, count(*) AS n FROM t UNION ALL SELECT 'expand', count(*) FROM x
UNION ALL SELECT 'merge', 2 * count(*) FROM h UNION ALL SELECT 'summarise', sum(length(id) + 3)::BIGINT - 1 FROM (SELECT id FROM h ORDER BY sim DESC, id LIMIT 10)""")
def pipeline_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that follow edges, add results, and write a summary."""
    g = _graph(spark, sf_dir)
    hits = g.nodes.filter("type = 'module'").select("id", (F.length("id") % 10 / 10.0).alias("similarity"), F.col("id").alias("text"))
    run = lambda *steps: S.Pipeline("walk", list(steps)).run(hits)
    n = lambda df, name: df.agg(F.lit(name).alias("step"), F.count(F.lit(1)).alias("n"))
    summary = run(("summarise", {})).select(F.lit("summarise").alias("step"), F.length("summary").cast("long").alias("n"))
    walked = n(run(("traverse", {"edges": g.edges, "relation": "contains"})), "traverse").unionByName(n(run(("expand", {"edges": g.edges})), "expand"))
    return walked.unionByName(n(run(("merge", {"other": hits})), "merge")).unionByName(summary)


@query("rate_limited", """WITH RECURSIVE o AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
b AS (SELECT event_id, user_id, ts, n, 2.0::DOUBLE AS level FROM o WHERE n = 1
  UNION ALL SELECT o.event_id, o.user_id, o.ts, o.n, least(2.0, b.level - CASE WHEN b.level >= 1 THEN 1 ELSE 0 END + epoch(o.ts - b.ts) / 36000.0) FROM b JOIN o ON o.user_id = b.user_id AND o.n = b.n + 1)
SELECT event_id, level >= 1 AS allowed FROM b""")
def rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return ingest.within_budget(ev, "user_id", ["ts", "event_id"], 1 / 36_000, 2.0).select("event_id", "allowed")


@query("usage_by_day", "SELECT source AS tenant, created_at::DATE AS day, count(*) AS operations, sum(strlen(text))::BIGINT AS bytes FROM documents WHERE source IS NOT NULL GROUP BY 1, 2")
def usage_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").filter("source is not null").select(F.col("source").alias("tenant"), F.col("created_at").alias("at"), F.octet_length("text").cast("long").alias("bytes"))
    return S.usage_log(d)


_PACKAGES = "p AS (SELECT trim(id) AS id, any_value(coalesce(list_filter(string_split(file_path, '/'), lambda x: x <> '')[1], '_root')) AS package FROM nodes WHERE file_path IS NOT NULL GROUP BY 1)"


def _placed(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    n = load(spark, sf_dir, "nodes").filter("file_path is not null").groupBy(F.trim("id").alias("id")).agg(F.min("file_path").alias("file_path"))
    return S.placed(n, **options)


@query("package_shards", f"WITH {_PACKAGES} SELECT package, count(*) AS nodes, 1::BIGINT AS shards FROM p GROUP BY 1")
def package_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package's nodes share one shard."""
    return _placed(spark, sf_dir).groupBy("package").agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("shard").alias("shards"))


@query("shard_overflow", f"WITH {_PACKAGES}, c AS (SELECT count(*) AS n FROM p) SELECT k::INT AS overflow, least(300, n - 300 * k)::BIGINT AS nodes FROM c, range(0, 100000) t(k) WHERE 300 * k < n")
def shard_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shard of at most 300 nodes, and as many overflow shards as it takes."""
    return _placed(spark, sf_dir, shards=1, most=300).groupBy("overflow").agg(F.count(F.lit(1)).alias("nodes"))


# ------------------------------------------------------------------------------------------------- memory, evaluation, ranking


@query("memory_touched", f"WITH {_MEM} SELECT k AS id, CASE WHEN importance >= 0.95 THEN coalesce(access_count, 0) + 1 ELSE access_count END AS access_count, CASE WHEN importance >= 0.95 THEN TIMESTAMP '2026-01-01' ELSE last_accessed_at END AS last_accessed_at FROM m")
def memory_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _memories(spark, sf_dir)
    return memory.touched(m, m.filter("importance >= 0.95"), F.lit(_T0).cast("timestamp_ntz")).select("id", "access_count", "last_accessed_at")


@query("memory_forgotten", f"WITH {_MEM} SELECT k AS id, CASE WHEN importance < 0.1 THEN 1 ELSE forgotten END AS forgotten, CASE WHEN importance < 0.1 THEN coalesce(forgotten_at, TIMESTAMP '2026-01-01') ELSE forgotten_at END AS forgotten_at FROM m")
def memory_forgotten(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _memories(spark, sf_dir)
    return memory.forget(m, m.filter("importance < 0.1"), F.lit(_T0).cast("timestamp_ntz")).select("id", "forgotten", "forgotten_at")


@query("memory_remembered", f"WITH {_MEM} SELECT k AS id, content FROM m UNION ALL SELECT 'new', 'A new one'")
def memory_remembered(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = spark.createDataFrame([("new", "A new one")], "id string, content string")
    return memory.remember(_memories(spark, sf_dir), new).select("id", "content")


@query("memory_related_new", "SELECT nullif(trim(source_id), '') AS source_id, nullif(trim(target_id), '') AS target_id FROM memory_edges UNION ALL SELECT 'a', 'b'")
def memory_related_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "memory_edges").select(F.nullif(F.trim("source_id"), F.lit("")).alias("source_id"), F.nullif(F.trim("target_id"), F.lit("")).alias("target_id"))
    return memory.relate(e, spark.createDataFrame([("a", "b")], "source_id string, target_id string"))


@query("memory_summary", f"WITH {_MEM} SELECT session_id, count(*) AS memories, sum(length(coalesce(content, '')))::BIGINT AS chars, min(k) AS first FROM m WHERE session_id IS NOT NULL GROUP BY 1")
def memory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary by a function of one's own: folded in parts of a session, merged to one row."""
    m = _memories(spark, sf_dir).filter("session_id is not null")

    def part(rows: pd.DataFrame) -> dict:
        return {"n": len(rows), "chars": int(rows["content"].fillna("").str.len().sum()), "first": min(rows["id"])}

    def merge(parts: list[dict]) -> dict:
        return {"memories": sum(p["n"] for p in parts), "chars": sum(p["chars"] for p in parts), "first": min(p["first"] for p in parts)}

    return memory.summarise_with(m, part, merge, "memories long, chars long, first string", ["id", "content"])


@query("fabric_context", "SELECT * FROM (VALUES ('Reads the plan', 1::BIGINT), ('Writes the plan', 1::BIGINT)) t(content, linked)")
def fabric_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two agents write, one links what it wrote to what the other wrote; a link to nothing is dropped."""
    rows = spark.createDataFrame([("a", "Writes the plan", _at(1)), ("b", "Knows the plan", _at(2)), ("a", "Writes the plan", _at(1))], "agent_id string, content string, created_at timestamp_ntz")
    f = memory.Fabric.empty(spark).write(rows)
    ids = {r["content"]: r["id"] for r in f.nodes.collect()}
    f = f.link(spark.createDataFrame([(ids["Writes the plan"], ids["Knows the plan"], "relates", _at(3)), (ids["Writes the plan"], "nothing", "relates", _at(3))], "source_id string, target_id string, type string, created_at timestamp_ntz"))
    f = f.record(spark.createDataFrame([("a", "Reads the plan", ids["Knows the plan"], _at(4))], "agent_id string, action string, target_id string, created_at timestamp_ntz"))
    return f.context("a").select("content", F.size("linked").cast("long").alias("linked"))


@query("events_tracked", "SELECT event_type, props AS query, value AS latency_ms, user_id::VARCHAR AS session_id, ts AS created_at FROM events WHERE event_type = 'click' ORDER BY ts DESC, props LIMIT 100")
def events_tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load(spark, sf_dir, "events").select("event_type", F.col("props").alias("query"), F.col("value").alias("latency_ms"), F.col("user_id").alias("session_id"), F.col("ts").alias("created_at"))
    kept = evaluation.track(spark.createDataFrame([], evaluation.SCHEMA), ev)
    return evaluation.tracked(kept, "click").select("event_type", "query", "latency_ms", "session_id", "created_at")


@query("rank_custom", f"WITH {_SCORED} SELECT vec_id, round(s_vector * s_pagerank, 6) AS score FROM s WHERE s_vector * s_pagerank >= 0.05")
def rank_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fusion of one's own: the product of the scores."""
    product = lambda df, weights: df.withColumn("score", F.col("score_vector") * F.col("score_pagerank"))
    ranker = ranking.Ranker({"vector": lambda d: d["s_vector"], "pagerank": lambda d: d["s_pagerank"]}, fusion=product, min_score=0.05)
    return ranker.rank(_scored(spark, sf_dir), "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query("agg_folded", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) - min(value) AS width FROM events GROUP BY 1")
def agg_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate of one's own, with its own way to merge."""

    def part(rows: pd.DataFrame) -> dict:
        v = rows["value"].dropna()
        return {"n": len(rows), "total": float(v.sum()), "low": float(v.min()), "high": float(v.max())}

    def merge(parts: list[dict]) -> dict:
        return {"n": sum(p["n"] for p in parts), "total": round(sum(p["total"] for p in parts), 4), "width": max(p["high"] for p in parts) - min(p["low"] for p in parts)}

    return R.folded(load(spark, sf_dir, "events"), ["event_type"], ["event_id", "value"], part, merge, "n long, total double, width double")


# ------------------------------------------------------------------------------------------------- scalars, SQL forms, chunks


@query("line_diffs", "SELECT doc_id, length(list_filter(list_zip(string_split(text, chr(10)), string_split(replace(text, 'shard', 'node'), chr(10))), lambda z: z[1] <> z[2]))::INT AS changed FROM documents WHERE text IS NOT NULL")
def line_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").filter("text is not null")
    diff = R.line_diff(F.col("text"), F.replace(F.col("text"), F.lit("shard"), F.lit("node")))
    return d.select("doc_id", diff.alias("_d")).select("doc_id", F.greatest("_d.added", "_d.removed").alias("changed"))


@query("urls_found", "SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '(https?://[^\\s<>()\\[\\]{}\"''`|\\\\^]+)', 1)) AS url FROM documents WHERE text IS NOT NULL")
def urls_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.explode(R.urls(F.col("text"))).alias("url"))


@query("video_ids", "SELECT * FROM (VALUES ('https://youtu.be/abcDEF12345', 'abcDEF12345'), ('https://www.youtube.com/watch?t=1&v=a-b_c123456', 'a-b_c123456'), ('https://example.org/embed/short', NULL)) t(url, video)")
def video_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("https://youtu.be/abcDEF12345",), ("https://www.youtube.com/watch?t=1&v=a-b_c123456",), ("https://example.org/embed/short",)]
    return spark.createDataFrame(rows, "url string").select("url", R.video_id(F.col("url")).alias("video"))


@query("scalar_maps", "SELECT s_suppkey, ['name', 'nation', 'rank'] AS keys, s_nationkey + 1 AS nation, NULL::INT AS other FROM supplier")
def scalar_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two maps merged, the later value of a key counts; keys and look-ups."""
    s = load(spark, sf_dir, "supplier")
    a = F.create_map(F.lit("name"), F.lit(0), F.lit("nation"), F.col("s_nationkey").cast("int"))
    b = F.create_map(F.lit("nation"), (F.col("s_nationkey") + 1).cast("int"), F.lit("rank"), F.lit(1))
    m = F.map_from_entries(F.concat(F.filter(F.map_entries(a), lambda e: ~F.map_contains_key(b, e["key"])), F.map_entries(b)))
    return s.select("s_suppkey", F.array_sort(F.map_keys(m)).alias("keys"), F.try_element_at(m, F.lit("nation")).alias("nation"), F.try_element_at(m, F.lit("none")).alias("other"))


_EXTENSIONS = "ex exs heex py pyi rs go js mjs cjs jsx ts tsx java c h cpp cc cxx hpp rb sql sh bash yml yaml json md none".split()


@query("languages", """SELECT e AS extension, CASE WHEN e IN ('ex', 'exs', 'heex') THEN 'elixir' WHEN e IN ('py', 'pyi') THEN 'python' WHEN e = 'rs' THEN 'rust' WHEN e = 'go' THEN 'go' WHEN e IN ('js', 'mjs', 'cjs', 'jsx') THEN 'javascript' WHEN e IN ('ts', 'tsx') THEN 'typescript'
WHEN e = 'java' THEN 'java' WHEN e IN ('c', 'h') THEN 'c' WHEN e IN ('cpp', 'cc', 'cxx', 'hpp') THEN 'cpp' WHEN e = 'rb' THEN 'ruby' WHEN e = 'sql' THEN 'sql' WHEN e IN ('sh', 'bash') THEN 'bash' WHEN e IN ('yml', 'yaml') THEN 'yaml' WHEN e = 'json' THEN 'json' WHEN e = 'md' THEN 'markdown' ELSE 'unknown' END AS language
FROM (SELECT unnest(string_split('ex exs heex py pyi rs go js mjs cjs jsx ts tsx java c h cpp cc cxx hpp rb sql sh bash yml yaml json md none', ' ')) AS e)""")
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(f"dir.d/File.{e.upper()}",) for e in _EXTENSIONS], "path string").select(F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)).alias("extension"), R.language_of("path").alias("language"))


@query("classified", "SELECT * FROM (VALUES ('SELECT a FROM t', 'simple'), ('SELECT count(*), sum(x) FROM t', 'analytics'), ('SELECT a FROM t JOIN u ON x = y', 'analytics'), ('SEMANTIC ''x'' WHERE a > 1', 'hybrid'), ('SEMANTIC ''x''', 'vector')) t(text, kind)")
def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = ["SELECT a FROM t", "SELECT count(*), sum(x) FROM t", "SELECT a FROM t JOIN u ON x = y", "SEMANTIC 'x' WHERE a > 1", "SEMANTIC 'x'"]
    return spark.createDataFrame([(t, classify(t)) for t in texts], "text string, kind string")


_LATERAL = "SELECT n_name, s_name FROM nation, LATERAL (SELECT s_name FROM supplier WHERE s_nationkey = n_nationkey ORDER BY s_name LIMIT 2) s"


@query("join_lateral", _LATERAL)
def join_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sql(spark, sf_dir, _LATERAL)


_USING = "SELECT k, a.n_name, b.r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) a JOIN (SELECT r_regionkey AS k, r_name FROM region) b USING (k)"


@query("join_using", _USING)
def join_using(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sql(spark, sf_dir, _USING)


@query("join_natural", _USING.replace("JOIN", "NATURAL JOIN").replace(" USING (k)", ""))
def join_natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sql(spark, sf_dir, _USING.replace("JOIN", "NATURAL JOIN").replace(" USING (k)", ""))


_CROSS = "SELECT r_name, n_name FROM region CROSS JOIN nation"


@query("join_cross", _CROSS)
def join_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of fixed size."""
    return R.sql(spark, sf_dir, _CROSS)


_INTERSECT = "SELECT o_custkey AS k FROM orders INTERSECT ALL SELECT c_custkey FROM customer WHERE c_nationkey < 10"


@query("set_intersect_all", _INTERSECT)
def set_intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sql(spark, sf_dir, _INTERSECT)


@query("graph_asked", f"""WITH {_G}, d AS (SELECT nn.id, nn.name, nn.type, (SELECT count(*) FROM e WHERE source_id = nn.id) + (SELECT count(*) FROM e WHERE target_id = nn.id) AS g FROM nn),
a AS (SELECT name FROM d WHERE type IN ('function', 'method', 'module', 'class') ORDER BY g DESC, id LIMIT 10),
b AS (SELECT e.source_id AS id, count(DISTINCT t.file_path) AS f FROM e JOIN nn s ON s.id = e.source_id JOIN nn t ON t.id = e.target_id WHERE e.type = 'calls' AND s.file_path <> t.file_path GROUP BY 1 HAVING count(DISTINCT t.file_path) >= 2 ORDER BY f DESC, id LIMIT 10)
SELECT 'Why do so many parts depend on ' || name || '?' AS question FROM a UNION ALL SELECT 'Does ' || id || ' belong to one of the files it ties together?' FROM b""")
def graph_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).report()["questions"]


@query("chunks_located", f"""WITH q AS (SELECT doc_id, unnest({_PARA}) AS x FROM documents WHERE text <> ''), s AS (SELECT length({_SENT.replace('{t}', 'x')}) AS n FROM q)
SELECT 'document' AS level, count(*) AS chunks, count(*) AS located FROM documents WHERE text <> '' UNION ALL SELECT 'paragraph', count(*), count(*) FROM q UNION ALL SELECT 'sentence', sum(n)::BIGINT, sum(n)::BIGINT FROM s""")
def chunks_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk is what its document holds between its byte offsets."""
    docs = _docs(spark, sf_dir)
    raw = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.encode("text", "utf-8").alias("_raw"))
    c = chunking.hierarchy(docs).join(raw, "doc_id")
    cut = F.decode(F.substring(F.col("_raw"), F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset")), "utf-8")
    return c.groupBy("level").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(cut == F.col("text")).alias("located"))


@query("chunks_packed", f"SELECT doc_id, array_to_string({_SENT.replace('{t}', 'text')}, ' ') AS text, true AS fits FROM documents WHERE text IS NOT NULL AND length({_SENT.replace('{t}', 'text')}) > 0")
def chunks_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed sentences lose nothing, and none is above the size unless it is one sentence."""
    c = chunking.chunk(_docs(spark, sf_dir), "sentence")
    alone = F.length("text") <= 500
    one = ~F.col("text").rlike(chunking.SENTENCE)
    texts = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))  # one text's chunks
    return c.groupBy("doc_id").agg(texts.alias("_t"), F.min(alone | one).alias("fits")).select("doc_id", F.array_join(F.transform("_t", lambda x: x["text"]), " ").alias("text"), "fits")


@query("chunks_headed", "SELECT doc_id, length(regexp_extract_all(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '(?m)^#{1,6}\\s'))::BIGINT AS headings FROM documents WHERE regexp_matches(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '(?m)^#{1,6}\\s')")
def chunks_headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown chunks begin at every heading."""
    c = chunking.chunk(_docs(spark, sf_dir), "markdown")
    return c.filter("heading_level > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("headings"))
