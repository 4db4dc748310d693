"""Ingestion as map stages over DataFrames: documents to chunks with vectors, source files to nodes and edges."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import BooleanType, StructField, StructType

from velumine.functions import vector as V
from velumine.functions.text import key
from velumine.operators import chunking, code, search
from velumine.operators.relational import language_of
from velumine.sources import readers

#: Documents of a shard before the next one is begun.
SHARD_DOCUMENTS = 10_000


def hash_vector(text: str | None, dims: int) -> list[float]:
    """Hashed word counts at unit length; zeros for a text without words."""
    v = [0.0] * dims
    for w in re.findall(r"\w+", (text or "").lower()):
        h = zlib.crc32(w.encode())
        v[h % dims] += 1.0 if h & 0x80000000 else -1.0
    n = math.sqrt(sum(x * x for x in v)) or 1.0
    return [x / n for x in v]


def embed(df: DataFrame, text: str = "text", into: str = "embedding", dims: int = 64, function: Callable[[Sequence[str | None]], Sequence[Sequence[float]]] | None = None) -> DataFrame:
    """``df`` with a vector per text. ``function`` gets a batch of texts, so a model is loaded and called batch by batch."""
    call = function or (lambda texts: [hash_vector(t, dims) for t in texts])

    @pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([list(map(float, v)) for v in call([None if t is None else str(t) for t in b])])

    return df.withColumn(into, run(F.col(text)))


def shard_numbers(df: DataFrame, id_col: str = "doc_id", size: int = SHARD_DOCUMENTS) -> DataFrame:
    """``df`` with ``shard_id``: about ``size`` documents each, by a hash, so that numbering needs no global order."""
    shards = max(1, -(-df.count() // size))
    return df.withColumn("shard_id", F.pmod(F.xxhash64(id_col), F.lit(shards)).cast("int"))


def index_documents(documents: DataFrame, dims: int = 64, function=None) -> DataFrame:
    """Chunks of three levels with vectors, each with the shard of its document."""
    sharded = shard_numbers(documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text"))
    chunks = chunking.hierarchy(sharded)
    return embed(chunks.join(sharded.select("doc_id", "shard_id"), "doc_id"), dims=dims, function=function)


def shard_routing(chunks: DataFrame, terms_of: Callable[[Column], Column]) -> DataFrame:
    """(shard_id, level, centroid, centroid_norm, n, bloom): what a router needs to know of each shard and level."""
    keyed = chunks.withColumn("_k", F.struct("shard_id", "level"))
    cent = search.centroids(keyed, "_k").select("_k.shard_id", "_k.level", "centroid", "centroid_norm", "n")
    words = chunks.filter("level = 'document'").select("shard_id", F.explode(terms_of(F.col("text"))).alias("term"))
    return cent.join(search.bloom_build(words, "shard_id", "term", size=100_000), "shard_id", "left")


def shard_registry(documents: DataFrame, by: str = "shard_id", text: str = "text", ts: str = "created_at") -> DataFrame:
    """(by, documents, bytes, latest, load): what each shard holds, and its bytes as a multiple of the mean shard's."""
    held = documents.groupBy(by).agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes"), F.max(ts).alias("latest"))
    mean = held.agg(F.avg("bytes").alias("_mean"))
    return held.crossJoin(F.broadcast(mean)).withColumn("load", F.round(F.try_divide(F.col("bytes"), F.col("_mean")), 4)).drop("_mean")  # one row


def rebalanced(documents: DataFrame, by: str = "shard_id", id_col: str = "doc_id", most: float = 1.5) -> DataFrame:
    """``documents`` in which shards of more than ``most`` times the mean number of rows are divided: their rows get as many new
    shards, numbered after the others, as bring them to the mean. Only the shards' counts are gathered."""
    counts = documents.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    mean = counts.agg(F.avg("_n").alias("_mean"), F.max(by).alias("_last"))
    cut = counts.crossJoin(F.broadcast(mean)).filter(F.col("_n") > most * F.col("_mean")).withColumn("_k", F.ceil(F.col("_n") / F.col("_mean")).cast("int"))
    first = F.col("_last") + F.coalesce(F.sum(F.col("_k") - 1).over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per divided shard
    cut = cut.select(by, "_k", first.alias("_first"))
    out = documents.join(F.broadcast(cut), by, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(id_col), F.col("_k")), F.lit(0)))
    return out.withColumn(by, F.when(F.col("_part") > 0, (F.col("_first") + F.col("_part")).cast(documents.schema[by].dataType)).otherwise(F.col(by))).drop("_k", "_first", "_part")


def sampled_centroid(df: DataFrame, by: str, vector: str = "embedding", rows: int = 100, seed: int = 7) -> DataFrame:
    """Centroids from ``rows`` members of each group taken by a seeded hash, for a quick refresh."""
    from velumine.operators.relational import top_per_key

    few = top_per_key(df.withColumn("_o", F.xxhash64(F.col(vector), F.lit(seed))), [by], [F.asc("_o")], rows, salt="_o")
    return search.centroids(few, by, vector)


def delete_documents(documents: DataFrame, chunks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks without the given ``doc_id``s."""
    return readers.delete_rows(documents, ids, "doc_id"), readers.delete_rows(chunks, ids.select(F.col("doc_id").cast("string").alias("doc_id")), "doc_id")


def source_files(files: DataFrame, embed_chars: int = 512, dims: int = 64) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of source files (path, text): symbols by line patterns, ``contains`` and ``calls`` among them.

    A node's id is ``file:name:line``. Unresolved calls lead to ``external:name`` and are inferred.
    """
    units = files.select(F.col("path").alias("id"), F.col("text").alias("source_text"), language_of("path").alias("language"))
    found, inside, made = None, None, None
    for language in code.PATTERNS:
        s = code.symbols(units, language).withColumn("language", F.lit(language))
        c = code.contains(units, language)
        k = code.calls(units, language)
        found, inside, made = (s, c, k) if found is None else (found.unionByName(s), inside.unionByName(c), made.unionByName(k))
    name = lambda n, line: F.concat_ws(":", "unit", n, line.cast("string"))
    nodes = found.filter("kind <> 'import'").select(name(F.col("name"), F.col("line")).alias("id"), "name", F.col("kind").alias("type"), "language", F.col("unit").alias("file_path"), F.col("line").alias("start_line"))
    text = units.select(F.col("id").alias("file_path"), F.left("source_text", F.lit(embed_chars)).alias("_t"))
    nodes = embed(nodes.join(text, "file_path"), "_t", dims=dims).drop("_t")
    first = nodes.groupBy("file_path", "name").agg(F.min_by("id", "start_line").alias("_i"))
    at = lambda c, out: first.select(F.col("file_path").alias("unit"), F.col("name").alias(c), F.col("_i").alias(out))
    holds = inside.join(at("parent", "source_id"), ["unit", "parent"]).select("source_id", F.concat_ws(":", "unit", "child", F.col("line").cast("string")).alias("target_id"), F.lit("contains").alias("type"), F.lit("EXTRACTED").alias("confidence"))
    uses = code.resolve(made, nodes.withColumn("type", F.lit("function"))).join(at("caller", "source_id"), ["unit", "caller"]).select("source_id", "target_id", F.lit("calls").alias("type"), "confidence")
    return nodes, holds.unionByName(uses).dropDuplicates(["source_id", "target_id", "type"])


def edge_ends(edges: DataFrame, by: str = "type") -> DataFrame:
    """(by, _e): the ends of edges, each once."""
    return edges.select(by, F.explode(F.array(key("source_id"), key("target_id"))).alias("_e")).filter("_e is not null").distinct()


def edge_blooms(edges: DataFrame, by: str = "type", size: int = 100_000, hashes: int = 7) -> DataFrame:
    """(by, bloom) of the ends of edges."""
    return search.bloom_build(edge_ends(edges, by), by, "_e", size, hashes)


def within_budget(df: DataFrame, by: str, order: Sequence[str], rate: float, burst: float, ts: str = "ts") -> DataFrame:
    """``df`` with ``allowed``: a token bucket per key that fills by ``rate`` a second up to ``burst``.

    What a request is allowed depends on those before it, so a key's requests are read in order; they pass through a task batch
    by batch, with one level kept, so a key of any size takes no more memory than a batch.
    """
    schema = StructType([*df.schema.fields, StructField("allowed", BooleanType())])
    keys = df.columns.index(by)
    seconds = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz")) / 1e6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, level, last = object(), burst, None
        for b in batches:
            out = []
            for k, t in zip(b.column(keys).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                if k != key:
                    key, level = k, burst
                elif t is not None and last is not None:
                    level = min(burst, level + (t - last) * rate)
                last = t
                out.append(level >= 1)
                level -= level >= 1
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.bool_())], names=[*b.schema.names[:-1], "allowed"])

    sorted_ = df.withColumn("_seconds", seconds).repartition(by).sortWithinPartitions(by, *order)
    return sorted_.mapInArrow(run, schema)


@udtf(returnType="chunk_index: int, start_offset: int, text: string")
class ChunkText:
    """A table function for SQL: windows of a text."""

    def eval(self, text: str, size: int, overlap: int):
        for i, at in enumerate(range(0, len(text or ""), max(size - overlap, 1))):
            yield i, at, text[at : at + size]


def register(spark) -> None:
    """Makes the table functions known to SQL: ``SELECT * FROM documents, LATERAL chunk_text(text, 500, 50)``."""
    spark.udtf.register("chunk_text", ChunkText)


def agent_context(memories: DataFrame, edges: DataFrame, query: Sequence[float], now: Column, session_id: str, k: int = 5, vector: str = "embedding") -> DataFrame:
    """(id, score, related): an agent's best memories with the ids they relate to, at most ten each."""
    from velumine.operators import memory

    hits = memory.recall(memories, query, now, k, session_id, vector=vector)
    near = memory.related(hits, edges, memories).groupBy(F.col("hit_id").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("related"))
    return hits.select("id", "score").join(near, "id", "left")


def latest_per_name(df: DataFrame, name: str, version: str) -> DataFrame:
    """The latest version of each name with its rank among versions."""
    w = Window.partitionBy(name).orderBy(F.desc(version))
    return df.withColumn("rank", F.row_number().over(w))


def compare_vectors(df: DataFrame, other: DataFrame, on: str, vector: str = "embedding") -> DataFrame:
    """(on, similarity) of the vectors that two tables give one key, as after a change of model."""
    b = other.select(on, F.col(vector).alias("_v"))
    return df.join(b, on).select(on, V.cosine(F.col(vector), F.col("_v")).alias("similarity"))
