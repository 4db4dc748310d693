"""Vector expressions over ``array<float>`` columns. All arithmetic is in double precision and stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vec(values: list[float]) -> Column:
    """A literal vector."""
    return F.array(*[F.lit(float(v)) for v in values])


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product; null if the lengths differ."""
    return F.when(F.size(a) == F.size(b), _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(v), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(n, F.lit(0.0)))


def squared_euclidean(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Distance by ``metric``: cosine, euclidean, squared_euclidean or dot (the negative inner product)."""
    if metric == "cosine":
        return F.lit(1.0) - cosine(a, b)
    if metric == "euclidean":
        return euclidean(a, b)
    if metric == "squared_euclidean":
        return squared_euclidean(a, b)
    if metric == "dot":
        return -dot(a, b)
    raise ValueError(f"unknown metric {metric!r}")


def similarity_of(d: Column, metric: str = "cosine") -> Column:
    """Similarity from a distance: 1 - d for cosine, -d for dot, 1 / (1 + d) otherwise."""
    if metric == "cosine":
        return F.lit(1.0) - d
    return -d if metric == "dot" else F.lit(1.0) / (F.lit(1.0) + d)


def truncate(v: Column, dims: int) -> Column:
    """The leading ``dims`` places, as matryoshka models allow."""
    return F.slice(v, 1, dims)


def sign_words(v: Column, dims: int, thresholds: list[float] | None = None, width: int = 32) -> Column:
    """Bits of ``v`` (value >= threshold, 0 by default) packed into ``bigint`` words of ``width`` bits, first place lowest."""
    t = thresholds or [0.0] * dims
    words = []
    for w in range(0, dims, width):
        bits = [F.when(F.get(v, F.lit(i)).cast("double") >= t[i], F.lit(1 << (i - w)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(w, min(dims, w + width))]
        word = bits[0]
        for b in bits[1:]:
            word = word + b
        words.append(word)
    return F.array(*words)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two packed vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)


def cell_path(v: Column, dims: int, width: int = 8, bins: int = 16) -> Column:
    """Cell of ``v``: its values scaled to [0, 1], the mean of each run of ``width`` places cut into ``bins``."""
    d = doubles(v)
    low, high = F.array_min(d), F.array_max(d)
    scale = F.when(high > low, high - low).otherwise(F.lit(1.0))
    cells = [F.floor((_sum(F.slice(d, i + 1, width)) / F.lit(float(width)) - low) / scale * (bins - 1)).cast("int") for i in range(0, dims, width)]
    return F.array(*cells)


def cells_near(a: Column, b: Column, radius: int) -> Column:
    """Whether two cells differ by at most ``radius`` at each level."""
    return F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= radius), lambda x: x)
