"""Chunking, grounding and retrieval queries over ``documents`` and ``chunks``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velumine.operators import chunking, retrieval
from velumine.plans.registry import query
from velumine.session import spread
from velumine.sources import readers
from velumine.sources.tables import load

_PARA = r"list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
# RE2 has no look-behind: sentence breaks are marked by a control character first.
_SENT = r"list_filter(list_transform(string_split(regexp_replace({t}, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
#: Java's \s is ASCII, as RE2's, but for the vertical tab, which the texts do not hold.


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(load(spark, sf_dir, "documents")).filter("text is not null")


@query("chunk_paragraphs", f"WITH p AS (SELECT doc_id, list_filter({_PARA}, lambda x: length(x) >= 50) AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, unnest(t) AS text, (generate_subscripts(t, 1) - 1)::INT AS chunk_index FROM p")
def chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.paragraphs(_docs(spark, sf_dir))


@query("chunk_hierarchy", f"""WITH p AS (SELECT doc_id, {_PARA} AS t FROM documents WHERE text <> ''), q AS (SELECT doc_id, unnest(t) AS x FROM p), s AS (SELECT doc_id, length({_SENT.replace('{t}', 'x')}) AS n FROM q)
SELECT doc_id::VARCHAR AS doc_id, 'document' AS level, 1::BIGINT AS n, strlen(text)::BIGINT AS bytes FROM documents WHERE text <> ''
UNION ALL SELECT doc_id::VARCHAR, 'paragraph', count(*), sum(strlen(x))::BIGINT FROM q GROUP BY 1
UNION ALL SELECT doc_id::VARCHAR, 'sentence', sum(n)::BIGINT, NULL FROM s GROUP BY 1""")
def chunk_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunking.hierarchy(_docs(spark, sf_dir))
    size = F.sum(F.when(F.col("level") != "sentence", F.col("end_offset") - F.col("start_offset")))
    return c.groupBy("doc_id", "level").agg(F.count(F.lit(1)).alias("n"), size.alias("bytes"))


@query("chunk_offsets")
def chunk_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks with byte offsets; the tests cut the texts by them."""
    return chunking.hierarchy(_docs(spark, sf_dir)).select("id", "doc_id", "parent_id", "level", "start_offset", "end_offset")


@query("chunk_fixed", """WITH s AS (SELECT doc_id, text, unnest(range(0, length(text), 450)) AS start FROM documents WHERE length(text) > 0)
SELECT doc_id, (start // 450)::INT AS chunk_index, start::INT AS start, substring(text, start + 1, 500) AS text FROM s WHERE length(substring(text, start + 1, 500)) >= 50""")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(_docs(spark, sf_dir), "fixed")


@query("chunk_sliding", """WITH s AS (SELECT doc_id, text, unnest(range(0, length(text), 600)) AS start FROM documents WHERE length(text) > 0)
SELECT doc_id, (start // 600)::INT AS chunk_index, start::INT AS start, substring(text, start + 1, 800) AS text FROM s WHERE length(substring(text, start + 1, 800)) >= 100""")
def chunk_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(_docs(spark, sf_dir), "sliding", size=800, overlap=200, least=100)


@query("chunk_packed")
def chunk_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(_docs(spark, sf_dir), "sentence")


@query("chunk_markdown")
def chunk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(_docs(spark, sf_dir), "markdown")


@query("html_strip", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(text, '(?is)<(script|style)\b[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'),
'&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '&#\d+;', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM documents WHERE text LIKE '%</%'""")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).filter(F.col("text").like("%</%")).select("doc_id", readers.strip_html(F.col("text")).alias("text"))


_CLEAN = r"""c AS (SELECT nullif(trim(id), '') AS id, min_by(row(nullif(trim(doc_id), ''), nullif(trim(parent_id), ''), lower(trim(level)), text, start_offset, end_offset), row(start_offset, text)) AS b FROM chunks GROUP BY 1),
k AS (SELECT id, b[1] AS doc_id, b[2] AS parent_id, b[3] AS level, b[4] AS text, b[5] AS start_offset, b[6] AS end_offset FROM c)"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.clean_chunks(load(spark, sf_dir, "chunks"))


@query("grounding", f"""WITH {_CLEAN} SELECT k.id, printf('[%s:%d-%d]', k.doc_id, k.start_offset, k.end_offset) AS citation, k.text AS chunk_text, p.text AS parent_context, length(d.text)::INT AS doc_chars
FROM k LEFT JOIN k p ON p.id = k.parent_id LEFT JOIN documents d ON 'doc' || d.doc_id = k.doc_id WHERE k.level = 'sentence' AND k.text LIKE '%tensor%' AND k.start_offset IS NOT NULL AND k.end_offset IS NOT NULL AND k.doc_id IS NOT NULL""")
def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chunks(spark, sf_dir)
    hits = c.filter("level = 'sentence' and text like '%tensor%' and start_offset is not null and end_offset is not null and doc_id is not null").select("id")
    docs = load(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), "doc_id").alias("doc_id"), "text")
    r = retrieval.ground(hits, c, docs)
    cite = retrieval.citation(F.col("reference.doc_id"), F.col("reference.start_offset"), F.col("reference.end_offset"))
    return r.select("id", cite.alias("citation"), F.col("reference.chunk_text").alias("chunk_text"), F.col("reference.parent_context").alias("parent_context"), F.length("reference.doc_text").alias("doc_chars"))


@query("chunk_neighbours", f"""WITH {_CLEAN}, o AS (SELECT id, doc_id, level, text, row_number() OVER (PARTITION BY doc_id, level ORDER BY start_offset, id) AS n FROM k)
SELECT a.id AS hit_id, b.id, (b.n - a.n) AS distance FROM o a JOIN o b ON a.doc_id = b.doc_id AND a.level = b.level AND abs(a.n - b.n) <= 2 AND a.n <> b.n WHERE a.level = 'paragraph' AND a.text LIKE '%tensor%'""")
def chunk_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chunks(spark, sf_dir)
    out = retrieval.neighbours(c.filter("level = 'paragraph' and text like '%tensor%'"), c, 2)
    return out.select("hit_id", "id", F.col("distance").cast("long").alias("distance"))


def _embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = load(spark, sf_dir, "vec_chunks").filter("size(embedding) = 64 and not exists(embedding, x -> x is null or isnan(x))")
    v = v.groupBy(F.btrim("id").alias("id")).agg(F.first("embedding").alias("embedding"))
    return _chunks(spark, sf_dir).join(v, "id").filter("text is not null").select("id", "text", "embedding")


def _asked(rows: DataFrame) -> list[float]:
    return list(rows.orderBy("id").select("embedding").first()[0])


@query("rag_retrieve")
def rag_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _embedded(spark, sf_dir)
    return retrieval.retrieve(rows, _asked(rows), terms=["tensor"])


@query("rag_hybrid")
def rag_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _embedded(spark, sf_dir)
    return retrieval.hybrid(rows, _asked(rows), ["tensor", "crater"], 10)
