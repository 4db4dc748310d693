"""Vectors as rows: which are usable, their unit form, and small models fitted on bounded samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velumine.session import Workspace, spread


def unpack(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Binary float32 vectors as a matrix."""
    return unpack_bytes(column, 4 * dim).view(np.float32)


def unpack_bytes(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Binary values of ``width`` bytes as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, width), dtype=np.uint8)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].reshape(-1, width)


def pack(matrix: np.ndarray) -> pa.Array:
    """A matrix of float32 (or bytes) as binary values, one per row."""
    matrix = np.ascontiguousarray(matrix)
    width = matrix.shape[1] * matrix.itemsize
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(matrix.tobytes())])


def usable(df: DataFrame, workspace: Workspace, id_col: Column, vector_col: str, dim: int = 64, scope: Column | None = None) -> DataFrame:
    """(_rid, _id, _scope, _v): records with a vector of ``dim`` finite numbers that are not all zero, at unit length.

    A record that stands in several rows counts once, by its first usable vector. ``_rid`` is a number for the record.
    """
    source = spread(df.select(id_col.alias("_id"), (scope if scope is not None else F.lit("")).alias("_scope"), F.col(vector_col).alias("_x")))
    source = source.filter((F.size("_x") == dim) & F.col("_id").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # nulls become NaN
            norm = np.sqrt((x * x).sum(1))
            good = np.flatnonzero(np.isfinite(x).all(1) & np.isfinite(norm) & (norm > 0))
            unit = (x[good] / norm[good, None]).astype(np.float32)
            take = pa.array(good)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pack(unit)], names=["_id", "_scope", "_v"])

    raw = workspace.keep(source.mapInArrow(run, "_id string, _scope string, _v binary").withColumn("_rid", F.monotonically_increasing_id()))
    # Only ids are shuffled to find repeated records, and only the numbers of the repeats are joined back.
    ids = raw.select("_id", "_scope", "_rid")
    first = ids.groupBy("_id", "_scope").agg(F.min("_rid").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    repeats = workspace.keep(ids.join(first, ["_id", "_scope"]).filter("_rid <> _first").select("_rid"))
    return raw.join(repeats, "_rid", "left_anti")


def sample(rows: DataFrame, total: int, size: int, dim: int = 64) -> np.ndarray:
    """About ``size`` vectors, chosen by a hash of the id, for fitting a model. Bounded; all rows take part in the rest."""
    every = max(1, total // max(1, size))
    got = rows.filter(F.pmod(F.xxhash64("_id", F.lit(17)), F.lit(every)) == 0).select("_v").limit(2 * size).toArrow()
    return unpack(got.column("_v"), dim).copy()


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids of at most ``k`` clusters by cosine."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    if not len(x):
        return np.zeros((0, x.shape[1]), dtype=np.float32)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        of = nearest(x, c)[0]
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        norm = np.linalg.norm(sums, axis=1)
        empty = norm < 1e-9
        sums[~empty] /= norm[~empty, None]
        sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
        c = sums.astype(np.float32)
    return c


def nearest(x: np.ndarray, c: np.ndarray, step: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """(index, product) of the centroid with the greatest inner product for each row."""
    at, best = np.empty(len(x), dtype=np.int64), np.empty(len(x), dtype=np.float32)
    for i in range(0, len(x), step):
        s = x[i : i + step] @ c.T
        at[i : i + step] = s.argmax(1)
        best[i : i + step] = s.max(1)
    return at, best


def codebooks(x: np.ndarray, m: int, words: int = 256, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """(m, words, dim / m) codewords of the parts of ``x``, by k-means."""
    rng = np.random.default_rng(seed)
    width = x.shape[1] // m
    words = max(1, min(words, len(x)))
    out = np.zeros((m, words, width), dtype=np.float32)
    for j in range(m):
        part = np.ascontiguousarray(x[:, j * width : (j + 1) * width])
        c = part[rng.choice(len(part), words, replace=False)].copy()
        for _ in range(rounds):
            of = quantise_part(part, c)
            n = np.bincount(of, minlength=words)
            sums = np.zeros_like(c)
            np.add.at(sums, of, part)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c).astype(np.float32)
        out[j] = c
    return out


def quantise_part(part: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (part @ c.T - 0.5 * (c * c).sum(1)).argmax(1)


def quantise(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Codes (rows, m) of ``x``."""
    m, _, width = books.shape
    out = np.empty((len(x), m), dtype=np.uint8)
    for j in range(m):
        for i in range(0, len(x), 8192):
            out[i : i + 8192, j] = quantise_part(x[i : i + 8192, j * width : (j + 1) * width], books[j])
    return out


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return np.concatenate([books[j][codes[:, j]] for j in range(books.shape[0])], axis=1) if len(codes) else np.zeros((0, books.shape[0] * books.shape[2]), np.float32)
