"""Exact and approximate vector search as DataFrame plans.

A search takes a DataFrame with an id and a vector column. One query vector is a literal, so a search is one scan with a
partial and a final top-k (``TakeOrderedAndProject``), no join. Many queries are a DataFrame of their own of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from velumine.functions import vector as V


def by_vector(df: DataFrame, query: Sequence[float], vector: str = "embedding", metric: str = "cosine") -> DataFrame:
    """``df`` with a ``similarity`` to ``query``."""
    q = V.vec(list(query))
    return df.withColumn("similarity", V.similarity_of(V.distance(F.col(vector), q, metric), metric))


def knn(df: DataFrame, query: Sequence[float], k: int, *, id_col: str = "id", vector: str = "embedding", where: str | Column | None = None, floor: float | None = None, ceiling: float | None = None, metric: str = "cosine") -> DataFrame:
    """The ``k`` most similar rows. ``where`` is applied before the search and pushed to the scan; ``floor`` keeps
    similarities of at least it, ``ceiling`` distances below it."""
    if where is not None:
        df = df.filter(where)
    out = by_vector(df, query, vector, metric)
    if floor is not None:
        out = out.filter(F.col("similarity") >= floor)
    if ceiling is not None:
        out = out.filter(1 - F.col("similarity") < ceiling)
    return out.orderBy(F.desc("similarity"), F.asc(id_col)).limit(k)


def knn_batch(df: DataFrame, queries: DataFrame, k: int, *, id_col: str = "id", vector: str = "embedding", bound: int = 10_000) -> DataFrame:
    """(query_id, id, similarity, rank) for a DataFrame of queries (query_id, query_vector).

    The query set is sent in blocks of about ``bound`` rows, each against one scan: every batch of vectors is one matrix
    product, of which only the ``k`` best of a query go on. Null and zero vectors are similar to nothing (0).
    """
    blocks = max(1, -(-queries.count() // bound))
    dims = df.filter(F.col(vector).isNotNull()).select(F.size(vector)).first()
    width = dims[0] if dims else 0
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {df.schema[id_col].dataType.simpleString()}, similarity double"
    found = None
    for i in range(blocks):
        block = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else queries
        got = block.select("query_id", V.doubles(F.col("query_vector")).alias("query_vector")).toArrow()  # about ``bound`` rows
        shared = df.sparkSession.sparkContext.broadcast((got.column("query_id").combine_chunks(), unit_rows(got.column("query_vector").combine_chunks(), width)))
        step = df.select(F.col(id_col).alias("id"), V.doubles(F.col(vector)).alias("_v")).mapInArrow(_best_in_batches(shared, k, width), kinds)
        found = step if found is None else found.unionByName(step)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def unit_rows(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows at unit length; null, short and zero ones are zeros."""
    out = np.zeros((len(vectors), width))
    fits = np.flatnonzero((pa.compute.fill_null(pa.compute.list_value_length(vectors), 0).to_numpy(zero_copy_only=False) == width)) if width else []
    if len(fits):
        out[fits] = vectors.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    out = np.nan_to_num(out)
    norm = np.sqrt((out * out).sum(1))
    return out / np.where(norm > 0, norm, 1)[:, None]


def _best_in_batches(shared, k: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = shared.value
        for b in batches:
            x = unit_rows(b.column(1), width)
            same = pa.compute.index_in(b.column(0), names) if b.num_rows else pa.array([], pa.int32())  # a query does not find itself
            own = np.where(same.is_null().to_numpy(zero_copy_only=False), -1, same.fill_null(0).to_numpy(zero_copy_only=False)) if b.num_rows else np.zeros(0, int)
            for i in range(0, len(q), 1024):
                s = q[i : i + 1024] @ x.T
                mine = np.flatnonzero((own >= i) & (own < i + 1024))
                s[own[mine] - i, mine] = -np.inf
                n = min(k, s.shape[1])
                if not n:
                    continue
                # Equal ones at the bound go on too: ties are broken by id later.
                bound = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
                row, col = np.nonzero((s >= bound[:, None]) & (s > -np.inf))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(row + i)), b.column(0).take(pa.array(col)), pa.array(s[row, col])], names=["query_id", "id", "similarity"])

    return run


def within(df: DataFrame, ids: DataFrame, query: Sequence[float], k: int, *, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """Search among the rows whose id is in ``ids``; an empty set finds nothing."""
    return knn(df.join(ids.select(id_col).distinct(), id_col, "left_semi"), query, k, id_col=id_col, vector=vector)


#: Candidates kept by a stage of a cascade, as multiples of the final limit, by dimensions.
FACTORS = {64: 50, 128: 10, 256: 3}


def cascade(df: DataFrame, query: Sequence[float], k: int, levels: Sequence[int], *, factors: dict[int, int] | None = None, id_col: str = "id", vector: str = "embedding", min_similarity: float = -1.0) -> DataFrame:
    """Coarse-to-fine search over leading places of the vectors: each level keeps a multiple of ``k`` for the next."""
    factors = factors or FACTORS
    out = df
    for i, dims in enumerate(levels):
        last = i == len(levels) - 1
        q = V.vec(list(query)[:dims])
        keep = k if last else k * factors.get(dims, 5)
        out = out.withColumn("similarity", V.cosine(V.truncate(F.col(vector), dims), q)).filter(1 - F.col("similarity") < 1 - min_similarity)
        out = out.orderBy(F.desc("similarity"), F.asc(id_col)).limit(keep)
        if not last:
            out = out.drop("similarity")
    return out.withColumn("similarity", F.round("similarity", 4))


def centroids(df: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """(by, centroid, centroid_norm, n): the mean vector of each group. Batches are summed in one product before the shuffle, so
    a group costs one row per task; the places of the few sums are then added up. Null places count as absent."""
    dims = df.filter(F.col(vector).isNotNull()).select(F.size(vector)).first()
    width = dims[0] if dims else 0
    group = df.schema[by].dataType

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, list] = {}
        for b in batches:
            x = np.full((b.num_rows, width), np.nan)
            lengths = pa.compute.fill_null(pa.compute.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            fits = np.flatnonzero(lengths == width)
            if len(fits) and width:
                x[fits] = b.column(1).take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            there = ~np.isnan(x)
            codes = b.column(0).dictionary_encode() if not pa.types.is_struct(b.column(0).type) else None
            keys = codes.dictionary.to_pylist() if codes is not None else None
            at = codes.indices.fill_null(len(keys)).to_numpy(zero_copy_only=False) if codes is not None else None
            if codes is None:
                rows = [tuple(r.values()) for r in b.column(0).to_pylist()]
                keys = list(dict.fromkeys(rows))
                place = {r: i for i, r in enumerate(keys)}
                at = np.array([place[r] for r in rows], dtype=np.int64)
            for i in np.unique(at).tolist():
                mine = at == i
                key = keys[i] if i < len(keys) else None
                got = held.setdefault(key, [np.zeros(width), np.zeros(width, np.int64), 0])
                got[0] += np.where(there[mine], x[mine], 0).sum(0)
                got[1] += there[mine].sum(0)
                got[2] += int((lengths[mine] > 0).sum())
        if held:
            names = [dict(zip([f.name for f in group.fields], k)) if isinstance(k, tuple) else k for k in held] if hasattr(group, "fields") else list(held)
            yield pa.RecordBatch.from_arrays([pa.array(names, to_arrow_type(group)), *(pa.array([list(v[i]) for v in held.values()], pa.list_(t)) for i, t in ((0, pa.float64()), (1, pa.int64()))), pa.array([v[2] for v in held.values()], pa.int64())], names=[by, "_s", "_c", "n"])

    partial = df.select(by, V.doubles(F.col(vector)).alias("_v")).mapInArrow(sums, StructType([StructField(by, group), *_parse("_s array<double>, _c array<bigint>, n bigint").fields]))
    places = partial.select(by, "n", F.posexplode(F.arrays_zip("_s", "_c")).alias("pos", "x"))
    means = places.groupBy(by, "pos").agg((F.sum("x._s") / F.sum("x._c")).alias("m"), F.sum("n").alias("n"))
    out = means.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("_p"), F.max("n").alias("n"))
    out = out.select(by, F.transform("_p", lambda p: p["m"]).alias("centroid"), "n")
    return out.withColumn("centroid_norm", V.norm(F.col("centroid")))


def _parse(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def route(shards: DataFrame, query: Sequence[float], top: int, *, floor: float = -1.0, terms: Sequence[str] | None = None, key: str = "shard_id") -> DataFrame:
    """The ``top`` shards by cosine of their centroid. With ``terms``, shards whose ``bloom`` can hold none of them are
    left out; a shard without a filter stays."""
    out = shards.withColumn("similarity", V.cosine(F.col("centroid"), V.vec(list(query)))).filter(F.col("similarity") >= floor)
    if terms is not None:
        out = out.filter(F.col("bloom").isNull() | may_hold_any(F.col("bloom"), list(terms)))
    return out.orderBy(F.desc("similarity"), key).limit(top)


def routed_knn(df: DataFrame, shards: DataFrame, query: Sequence[float], k: int, top: int, *, key: str = "shard_id", id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """Search only in the nearest shards; their few keys become a filter on the scan."""
    near = [r[key] for r in route(shards, query, top, key=key).select(key).collect()]  # at most `top` keys
    return knn(df, query, k, id_col=id_col, vector=vector, where=F.col(key).isin(near))


#: Positions of a filter and hashes per term.
BLOOM_SIZE, BLOOM_HASHES = 10_000, 5


def bloom_positions(term: Column, size: int = BLOOM_SIZE, hashes: int = BLOOM_HASHES) -> Column:
    return F.array(*[F.pmod(F.xxhash64(term, F.lit(i)), F.lit(size)).cast("int") for i in range(hashes)])


def bloom_build(df: DataFrame, by: str, term: str, size: int = BLOOM_SIZE, hashes: int = BLOOM_HASHES) -> DataFrame:
    """(by, bloom): the set positions of each group's terms, at most ``size`` of them."""
    spots = df.select(by, F.explode(bloom_positions(F.lower(F.col(term)), size, hashes)).alias("_s")).distinct()
    return spots.groupBy(by).agg(F.array_sort(F.collect_list("_s")).alias("bloom"))


def may_hold(bloom: Column, term: str | Column, size: int = BLOOM_SIZE, hashes: int = BLOOM_HASHES) -> Column:
    """Whether a filter may hold ``term``; never false for one that was added."""
    t = F.lower(F.lit(term) if isinstance(term, str) else term)
    return F.forall(bloom_positions(t, size, hashes), lambda p: F.array_contains(bloom, p))


def all_held(terms: DataFrame, blooms: DataFrame, by: str, term: str, size: int = BLOOM_SIZE, hashes: int = BLOOM_HASHES) -> DataFrame:
    """(by, holds): whether each group's filter may hold all of the group's terms. For many terms: positions are looked up by a
    join, at most ``size`` of a group, where ``may_hold`` goes through the whole filter for each position of each term."""
    held = blooms.select(by, F.explode("bloom").alias("_p"), F.lit(True).alias("_set"))
    asked = terms.filter(F.col(by).isNotNull()).select(by, F.explode(bloom_positions(F.lower(F.col(term)), size, hashes)).alias("_p")).distinct()
    return asked.join(held, [by, "_p"], "left").groupBy(by).agg(F.min(F.coalesce("_set", F.lit(False))).alias("holds"))


def may_hold_any(bloom: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | may_hold(bloom, t)
    return out
