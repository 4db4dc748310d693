"""Grounding, citations and retrieval-augmented context."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velumine.functions.text import key
from velumine.operators import search
from velumine.operators.relational import merge_hits
from velumine.operators.state import Handles
from velumine.session import Workspace


def ground(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """``hits`` (chunk id) with a ``reference``: document, offsets, chunk text, parent's text and level. Two left joins
    from the few hits, no look-up per row."""
    c = chunks.select("id", "doc_id", "parent_id", "level", "text", "start_offset", "end_offset")
    p = chunks.select(F.col("id").alias("parent_id"), F.col("text").alias("_parent"))
    d = documents.select("doc_id", F.col("text").alias("_doc"))
    rows = hits.join(c, "id", "left").join(p, "parent_id", "left").join(d, "doc_id", "left")
    ref = F.struct(F.col("id").alias("chunk_id"), "doc_id", F.col("_doc").alias("doc_text"), F.col("text").alias("chunk_text"), "start_offset", "end_offset", F.col("_parent").alias("parent_context"), "level")
    return rows.select(*hits.columns, ref.alias("reference"))


def citation(doc_id: Column, start: Column, end: Column) -> Column:
    """``[doc:start-end]``."""
    return F.format_string("[%s:%d-%d]", doc_id, start, end)


def highlight(doc_text: Column, start: Column, end: Column) -> Column:
    """(before, chunk, after) by byte offsets."""
    raw = F.encode(doc_text, "utf-8")
    cut = lambda a, n: F.decode(F.substring(raw, a, n), "utf-8")
    return F.struct(cut(F.lit(1), start).alias("before"), cut(start + 1, end - start).alias("chunk"), cut(end + 1, F.octet_length(doc_text) - end).alias("after"))


def neighbours(hits: DataFrame, chunks: DataFrame, window: int = 1) -> DataFrame:
    """(hit_id, id, distance): the chunks of the same document and level within ``window`` places of each hit."""
    # Only documents that hold a hit are numbered.
    docs = chunks.join(hits.select("id").distinct(), "id", "left_semi").select("doc_id").distinct()
    order = Window.partitionBy("doc_id", "level").orderBy("start_offset", "id")
    placed = chunks.join(docs, "doc_id", "left_semi").select("id", "doc_id", "level", F.row_number().over(order).alias("_n"))
    h = hits.select(F.col("id").alias("hit_id")).join(placed.withColumnRenamed("id", "hit_id"), "hit_id")
    wanted = h.select("hit_id", "doc_id", "level", "_n", F.explode(F.sequence(F.col("_n") - window, F.col("_n") + window)).alias("_m"))
    near = wanted.join(placed.withColumnRenamed("_n", "_m"), ["doc_id", "level", "_m"])
    return near.filter("id <> hit_id").select("hit_id", "id", (F.col("_m") - F.col("_n")).alias("distance"))


def assemble(chunks: Column, budget: int = 4000) -> Column:
    """Texts taken in order while they fit in ``budget`` characters; one that does not fit is skipped, later ones are tried."""
    zero = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        fits = acc["used"] + F.length(t) <= budget
        return F.struct(F.when(fits, acc["used"] + F.length(t)).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["out"], F.array(t))).otherwise(acc["out"]).alias("out"))

    return F.array_join(F.aggregate(chunks, zero, step, lambda a: a["out"]), "\n\n")


def find(chunks: DataFrame, query: Sequence[float], workspace: Workspace, k: int = 5, floor: float = 0.3, terms: Sequence[str] = ()) -> DataFrame:
    """(id, text, similarity): the best chunks for a query vector, by keywords at similarity 0.5 where vectors find nothing."""
    hits = workspace.keep(search.knn(chunks, query, k, floor=floor).select("id", "text", "similarity"))
    if not terms or not hits.isEmpty():
        return hits
    cond = F.lit(False)
    for t in terms:
        cond = cond | F.col("text").ilike(f"%{t}%")
    return chunks.filter(cond).select("id", "text", F.lit(0.5).alias("similarity")).orderBy("id").limit(k)


def expand(hits: DataFrame, chunks: DataFrame, window: int = 1) -> DataFrame:
    """``hits`` with their text between those of their neighbours of the same document and level."""
    near = neighbours(hits, chunks, window).join(chunks.select("id", F.col("text").alias("_t")), "id").filter("_t is not null")
    own = hits.select(F.col("id").alias("hit_id"), F.lit(0).alias("distance"), F.col("text").alias("_t"))
    every = near.select("hit_id", "distance", "_t").unionByName(own)
    text = every.groupBy("hit_id").agg(F.array_sort(F.collect_list(F.struct("distance", "_t"))).alias("_all"))  # at most 2 * window + 1
    joined = text.select(F.col("hit_id").alias("id"), F.array_join(F.transform("_all", lambda x: x["_t"]), "\n").alias("text"))
    return hits.drop("text").join(joined, "id")


def context_of(hits: DataFrame, budget: int = 4000) -> DataFrame:
    """(context, sources, tokens) of a few hits, the most similar first."""
    best = F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("_s"), "id", "text")))  # at most k rows
    out = hits.agg(best.alias("_h"))
    context = assemble(F.transform("_h", lambda h: h["text"]), budget)
    return out.select(context.alias("context"), F.transform("_h", lambda h: h["id"]).alias("sources"), F.floor(F.length(context) / 4).cast("long").alias("tokens"))


def retrieve(chunks: DataFrame, query: Sequence[float], k: int = 5, floor: float = 0.3, budget: int = 4000, terms: Sequence[str] = (), all_chunks: DataFrame | None = None, workspace: Workspace | None = None) -> DataFrame:
    """(context, sources, tokens): context for a query vector; with ``all_chunks`` each hit stands between its neighbours."""
    hits = find(chunks, query, workspace or Workspace(chunks.sparkSession, "rag"), k, floor, terms)
    return context_of(hits if all_chunks is None else expand(hits, all_chunks), budget)


def compressed(handles: Handles, asked: str, hits: DataFrame) -> str:
    """The stub of a retrieval: its hits are stored under a name made of the question, to be expanded on demand."""
    if hits.isEmpty():
        return "$rag_empty: Array(0) []"
    name = "$rag_" + re.sub("[^a-z0-9]+", "_", asked.lower()).strip("_")[:40]
    return handles.store(name, hits, ["id"], ttl_seconds=600)


def hybrid(chunks: DataFrame, query: Sequence[float], terms: Sequence[str], k: int = 5) -> DataFrame:
    """Twice ``k`` vector hits, then keyword hits that they lack, cut to ``k``."""
    v = search.knn(chunks, query, 2 * k).select("id")
    cond = F.lit(False)
    for t in terms:
        cond = cond | F.col("text").ilike(f"%{t}%")
    w = chunks.filter(cond).select("id").orderBy("id").limit(2 * k)
    return merge_hits(v, w, "id").orderBy("source_rank", "id").limit(k)


def clean_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks with keys and levels in canonical notation, each once."""
    rows = chunks.select(key("id").alias("id"), key("doc_id").alias("doc_id"), key("parent_id").alias("parent_id"), F.lower(F.btrim("level")).alias("level"), "text", "start_offset", "end_offset", "pagerank")
    return rows.groupBy("id").agg(F.min_by(F.struct("doc_id", "parent_id", "level", "text", "start_offset", "end_offset", "pagerank"), F.struct("start_offset", "text")).alias("_c")).select("id", "_c.*")
