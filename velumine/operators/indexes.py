"""Index strategies behind one interface: ``fit`` on vectors, ``add``, ``delete``, ``search`` for one query, ``stats``, ``save``.

Names of strategies: ``exact`` (also ``centroid``), ``hnsw``, ``ivf``, ``pq``, ``binary``, ``quantized``. Models are fitted once, on
a bounded sample; rows that are added later are encoded by the models there are. ``migrate`` fits another strategy on the rows of
an index, and a ``Switch`` answers by one index until another is ready.
"""

from __future__ import annotations

import copy
import heapq
import json
import math
from abc import ABC, abstractmethod
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from velumine.functions import vector as V
from velumine.operators import search


class Index(ABC):
    """A fitted index over (id, vector); the vectors it was fitted on may be a bounded sample, those it holds are all."""

    def __init__(self, id_col: str = "id", vector: str = "embedding", dims: int = 64) -> None:
        self.id_col, self.vector, self.dims = id_col, vector, dims
        self.df: DataFrame | None = None

    def train(self, df: DataFrame) -> None:
        """Fits the models, if there are any."""

    @abstractmethod
    def encode(self, df: DataFrame) -> DataFrame:
        """(id, vector) with what the index holds of each vector."""

    @abstractmethod
    def search(self, query: Sequence[float], k: int) -> DataFrame: ...

    def search_batch(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, id, similarity, rank) for (query_id, query_vector). Exact search, unless a strategy has a way of its own."""
        return search.knn_batch(self.df, queries, k, id_col=self.id_col, vector=self.vector)

    def fit(self, df: DataFrame) -> Index:
        df = df.select(self.id_col, self.vector)
        self.train(df)
        self.df = self.encode(df)
        return self

    def _with(self, df: DataFrame) -> Index:
        out = copy.copy(self)
        out.df = df
        return out

    def add(self, df: DataFrame) -> Index:
        """With more vectors, encoded by the models there are; those of an id that is there already are replaced."""
        new = df.select(self.id_col, self.vector)
        kept = self.df.join(new.select(self.id_col).distinct(), self.id_col, "left_anti")
        return self._with(kept.unionByName(self.encode(new)))

    def delete(self, ids: DataFrame) -> Index:
        return self._with(self.df.join(ids.select(self.id_col).distinct(), self.id_col, "left_anti"))

    def stats(self) -> DataFrame:
        return self.df.agg(F.count(F.lit(1)).alias("vectors"))

    def save(self, path: str) -> None:
        """The indexed rows as Parquet, and the fitted models (lists of numbers) beside them."""
        self.df.write.mode("overwrite").parquet(f"{path}/rows")
        model = {k: v for k, v in vars(self).items() if k != "df"}
        self.df.sparkSession.createDataFrame([(type(self).__name__, json.dumps(model))], "kind string, model string").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")


def load(spark: SparkSession, path: str) -> Index:
    """An index that was saved."""
    row = spark.read.parquet(f"{path}/model").first()
    index = object.__new__({c.__name__: c for c in STRATEGIES.values()}[row["kind"]])
    vars(index).update(json.loads(row["model"]), df=spark.read.parquet(f"{path}/rows"))
    return index


class ExactIndex(Index):
    def encode(self, df: DataFrame) -> DataFrame:
        return df

    def search(self, query: Sequence[float], k: int) -> DataFrame:
        return search.knn(self.df, query, k, id_col=self.id_col, vector=self.vector).select(self.id_col, "similarity")


class IvfIndex(Index):
    """Inverted lists by spherical k-means; a query reads the lists nearest to it."""

    def __init__(self, n_lists: int = 100, n_probe: int = 10, sample: int = 100_000, seed: int = 42, **kw) -> None:
        super().__init__(**kw)
        self.n_lists, self.n_probe, self.sample, self.seed = n_lists, n_probe, sample, seed

    def train(self, df: DataFrame) -> None:
        fit_on = df.orderBy(F.xxhash64(self.id_col)).limit(self.sample).select(array_to_vector(V.doubles(F.col(self.vector))).alias("_f"))
        k = max(2, min(self.n_lists, fit_on.count()))
        model = KMeans(k=k, distanceMeasure="cosine", seed=self.seed, maxIter=20, featuresCol="_f", predictionCol="list_id").fit(fit_on)
        self.centers = [c.tolist() for c in model.clusterCenters()]  # n_lists vectors

    def encode(self, df: DataFrame) -> DataFrame:
        return _nearest(df, self.vector, {"list_id": (0, self.dims, self.centers, True)})

    def search(self, query: Sequence[float], k: int) -> DataFrame:
        qn = math.sqrt(sum(x * x for x in query)) or 1.0
        score = lambda c: sum(a * b for a, b in zip(query, c)) / (qn * (math.sqrt(sum(x * x for x in c)) or 1.0))
        near = sorted(range(len(self.centers)), key=lambda i: -score(self.centers[i]))[: self.n_probe]
        return search.knn(self.df, query, k, id_col=self.id_col, vector=self.vector, where=F.col("list_id").isin(near)).select(self.id_col, "similarity")

    def search_batch(self, queries: DataFrame, k: int) -> DataFrame:
        """Each query meets the vectors of the lists it probes in an equi-join on the list."""
        asked = _nearest(queries, "query_vector", {"list_id": (0, self.dims, self.centers, True)}, self.n_probe)
        met = asked.select("query_id", "query_vector", F.explode("list_id").alias("list_id")).join(self.df, "list_id").filter(F.col("query_id") != F.col(self.id_col))
        scored = met.select("query_id", F.col(self.id_col).alias("id"), V.cosine(F.col(self.vector), F.col("query_vector")).alias("similarity"))
        return _ranked(scored, k)

    def stats(self) -> DataFrame:
        sizes = self.df.groupBy("list_id").count()
        return sizes.agg(F.sum("count").alias("vectors"), F.count(F.lit(1)).alias("lists"), F.round(F.avg("count"), 4).alias("avg_list_size"))


class PqIndex(Index):
    """Product quantisation: one codebook per part, asymmetric distances by table look-up, similarity 1 / (1 + distance)."""

    def __init__(self, m: int = 8, k_sub: int = 256, sample: int = 50_000, seed: int = 42, **kw) -> None:
        super().__init__(**kw)
        if self.dims % m:
            raise ValueError("dims must be divisible by m")
        self.m, self.k_sub, self.sample, self.seed = m, k_sub, sample, seed

    def train(self, df: DataFrame) -> None:
        width = self.dims // self.m
        fit_on = df.orderBy(F.xxhash64(self.id_col)).limit(self.sample)
        k = max(2, min(self.k_sub, fit_on.count()))
        self.books: list[list[list[float]]] = []
        for j in range(self.m):
            part = array_to_vector(V.doubles(F.slice(F.col(self.vector), j * width + 1, width)))
            model = KMeans(k=k, seed=self.seed + j, maxIter=10, featuresCol="_f", predictionCol=f"_c{j}").fit(fit_on.select(part.alias("_f")))
            self.books.append([c.tolist() for c in model.clusterCenters()])

    def encode(self, df: DataFrame) -> DataFrame:
        width = self.dims // self.m
        coded = _nearest(df, self.vector, {f"_c{j}": (j * width, width, book, False) for j, book in enumerate(self.books)})
        return coded.withColumn("codes", F.array(*[F.col(f"_c{j}").cast("smallint") for j in range(self.m)])).drop(*[f"_c{j}" for j in range(self.m)])

    def search(self, query: Sequence[float], k: int, rerank: int = 0) -> DataFrame:
        width = self.dims // self.m
        tables = [[sum((a - b) ** 2 for a, b in zip(query[j * width : (j + 1) * width], word)) for word in book] for j, book in enumerate(self.books)]
        d = F.lit(0.0)
        for j, t in enumerate(tables):
            d = d + F.get(F.array(*[F.lit(x) for x in t]), F.get("codes", F.lit(j)).cast("int"))
        scored = self.df.withColumn("similarity", 1 / (1 + F.sqrt(d)))
        best = scored.orderBy(F.desc("similarity"), self.id_col).limit(max(k, rerank))
        if rerank:
            return search.knn(best.drop("similarity"), query, k, id_col=self.id_col, vector=self.vector).select(self.id_col, "similarity")
        return best.select(self.id_col, "similarity")

    def search_batch(self, queries: DataFrame, k: int, rerank: int = 10) -> DataFrame:
        """Asymmetric distances by look-ups in each query's tables, batch by batch of codes; the best ``rerank`` times ``k`` of a
        batch are compared exactly. The query set is small and checked to be."""
        if queries.limit(10_001).count() > 10_000:
            raise ValueError("more than 10,000 queries")
        got = queries.select("query_id", V.doubles(F.col("query_vector")).alias("q")).toArrow()
        q = np.array(got.column("q").to_pylist(), dtype=np.float64).reshape(len(got), -1)
        width, dims = self.dims // self.m, self.dims
        tables = [((q[:, None, j * width : (j + 1) * width] - np.array(book)[None]) ** 2).sum(2) for j, book in enumerate(self.books)]
        shared = self.df.sparkSession.sparkContext.broadcast((got.column("query_id").to_pylist(), tables, q))
        id_col, vector = self.id_col, self.vector

        def run(batches):
            names, lookup, asked = shared.value
            for b in batches:
                if not len(b):
                    continue
                codes = np.array(b["codes"].tolist(), dtype=np.int64)
                x = np.array(b[vector].tolist(), dtype=np.float64).reshape(len(b), dims)
                x /= np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None]
                ids, out = b[id_col].to_numpy(), []
                for i, name in enumerate(names):
                    d = sum(t[i][codes[:, j]] for j, t in enumerate(lookup))
                    few = np.argpartition(d, min(len(d) - 1, rerank * k))[: rerank * k]
                    sim = x[few] @ (asked[i] / max(float(np.sqrt(asked[i] @ asked[i])), 1e-300))
                    out.append(pd.DataFrame({"query_id": name, "id": ids[few], "similarity": sim})[ids[few] != name])
                yield pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "similarity": []})

        kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {self.df.schema[id_col].dataType.simpleString()}, similarity double"
        return _ranked(self.df.select(id_col, vector, "codes").mapInPandas(run, kinds), k)

    def stats(self) -> DataFrame:
        return self.df.agg(F.count(F.lit(1)).alias("vectors")).withColumn("compression", F.lit(4.0 * self.dims / self.m))


class BinaryIndex(Index):
    """Sign bits; similarity is the share of equal bits. A place's threshold is 0, its mean with ``thresholds="mean"``, or given."""

    def __init__(self, thresholds: Sequence[float] | str | None = None, **kw) -> None:
        super().__init__(**kw)
        self.by_mean = thresholds == "mean"
        self.thresholds = [0.0] * self.dims if thresholds is None or self.by_mean else list(thresholds)

    def train(self, df: DataFrame) -> None:
        if self.by_mean:
            one = search.centroids(df.withColumn("_all", F.lit(0)), "_all", self.vector).select("centroid").first()
            self.thresholds = list(one[0]) if one else self.thresholds

    def encode(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bits", V.sign_words(F.col(self.vector), self.dims, self.thresholds))

    def search(self, query: Sequence[float], k: int) -> DataFrame:
        q = V.sign_words(V.vec(list(query)), self.dims, self.thresholds)
        out = self.df.withColumn("hamming", V.hamming(F.col("bits"), q)).withColumn("similarity", 1 - F.col("hamming") / F.lit(float(self.dims)))
        return out.orderBy("hamming", self.id_col).limit(k).select(self.id_col, "hamming", "similarity")


class CellIndex(Index):
    """Scalar-quantised cells: candidates lie in cells within a radius at each level and are compared exactly."""

    def __init__(self, width: int = 8, bins: int = 16, radius: int = 2, **kw) -> None:
        super().__init__(**kw)
        self.width, self.bins, self.radius = width, bins, radius

    def encode(self, df: DataFrame) -> DataFrame:
        return df.withColumn("cell", V.cell_path(F.col(self.vector), self.dims, self.width, self.bins))

    def search(self, query: Sequence[float], k: int) -> DataFrame:
        q = V.cell_path(V.vec(list(query)), self.dims, self.width, self.bins)
        return search.knn(self.df, query, k, id_col=self.id_col, vector=self.vector, where=V.cells_near(F.col("cell"), q, self.radius)).select(self.id_col, "similarity")


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def _nearest(df: DataFrame, vector: str, places: dict[str, tuple[int, int, list[list[float]], bool]], several: int = 0) -> DataFrame:
    """``df`` with, for each name, the number of the nearest centre to the places [first, first + width) of the vector, by cosine
    or by distance: one matrix product per batch. Vectors of another length have no number. With ``several``, the numbers of so
    many nearest ones."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    width = max((first + n for first, n, _, _ in places.values()), default=0)
    models = {}
    for name, (first, n, centres, cosine) in places.items():
        c = np.array(centres, dtype=np.float64)
        if cosine:
            norm = np.sqrt((c * c).sum(1))
            c = c / np.where(norm > 0, norm, 1)[:, None]
        models[name] = (first, n, c, cosine)
    shared = df.sparkSession.sparkContext.broadcast(models)
    kept = df.columns

    def run(batches):
        for b in batches:
            column = b.column(len(kept))
            fits = np.flatnonzero(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False) >= width)
            x = np.nan_to_num(np.array([v[:width] for v in column.take(pa.array(fits)).to_pylist()], dtype=np.float64).reshape(len(fits), width))
            out = []
            for first, n, c, cosine in shared.value.values():
                s = x[:, first : first + n] @ c.T - (0 if cosine else 0.5 * (c * c).sum(1))
                if several:
                    best = np.argsort(-s, axis=1, kind="stable")[:, :several]
                    lists: list = [None] * b.num_rows
                    for i, row in zip(fits.tolist(), best.tolist()):
                        lists[i] = row
                    out.append(pa.array(lists, pa.list_(pa.int32())))
                    continue
                number = np.full(b.num_rows, -1, dtype=np.int32)
                number[fits] = s.argmax(1) if len(fits) else []
                out.append(pa.array(number, mask=number < 0))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *out], names=[*kept, *shared.value])

    schema = StructType([*df.schema.fields, *[StructField(n, ArrayType(IntegerType()) if several else IntegerType()) for n in places]])
    return df.withColumn("_v", V.doubles(F.col(vector))).mapInArrow(run, schema)


class HnswIndex(Index):
    """Navigable small-world graphs, one for each part of about ``part_rows`` vectors: a graph is built by one insertion after
    another, so parts are what is spread. A query descends the layers of every part's graph and goes on with ``ef_search``
    candidates on the lowest; the best of all parts are the answer. A vector's layer is drawn from a hash of its id."""

    def __init__(self, m: int = 16, ef_construction: int = 100, ef_search: int = 100, part_rows: int = 2_000, **kw) -> None:
        super().__init__(**kw)
        self.m, self.ef_construction, self.ef_search, self.part_rows = m, ef_construction, ef_search, part_rows

    def encode(self, df: DataFrame) -> DataFrame:
        parts = max(1, -(-df.count() // self.part_rows))
        if self.df is not None:  # rows that are added have graphs of their own
            first = (self.df.agg(F.max("part")).first()[0] or 0) + 1
        else:
            first = 0
        m, ef, dims, id_col, vector = self.m, self.ef_construction, self.dims, self.id_col, self.vector
        placed = df.filter(F.size(vector) == dims).withColumn("part", F.lit(first) + F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int")).withColumn("_u", F.pmod(F.xxhash64(id_col, F.lit(1)), F.lit(1_000_003)))
        schema = StructType([*df.schema.fields, *StructType.fromDDL("part int, layer int, place int, near array<array<int>>").fields])

        def build(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("_u", kind="stable").reset_index(drop=True)
            graph = SmallWorld(np.array(rows[vector].tolist(), dtype=np.float64).reshape(len(rows), dims), m, ef)
            u = (rows["_u"].to_numpy() + 1) / 1_000_004
            graph.build(np.floor(-np.log(u) / math.log(m)).astype(int))
            return pd.DataFrame({**{c: rows[c] for c in (id_col, vector)}, "part": rows["part"], "layer": graph.layers, "place": range(len(rows)), "near": [graph.near[i] for i in range(len(rows))]})

        return placed.groupBy("part").applyInPandas(build, schema)

    def search(self, query: Sequence[float], k: int) -> DataFrame:
        m, ef, dims, id_col, vector = self.m, max(self.ef_search, k), self.dims, self.id_col, self.vector
        asked = list(map(float, query))

        def walk(rows: pd.DataFrame) -> pd.DataFrame:
            graph = SmallWorld.of(rows, dims, m, ef, vector)
            rows = rows.sort_values("place", kind="stable").reset_index(drop=True)
            found = graph.find(np.array(asked), k, ef)
            return pd.DataFrame({id_col: [rows[id_col][i] for _, i in found], "similarity": [s for s, _ in found]})

        kind = self.df.schema[id_col].dataType.simpleString()
        best = self.df.groupBy("part").applyInPandas(walk, f"`{id_col}` {kind}, similarity double")
        return best.orderBy(F.desc("similarity"), id_col).limit(k)

    def search_batch(self, queries: DataFrame, k: int) -> DataFrame:
        """All queries walk every part's graph, in one task a part. The query set is small and checked to be."""
        if queries.limit(10_001).count() > 10_000:
            raise ValueError("more than 10,000 queries")
        m, ef, dims, id_col, vector = self.m, max(self.ef_search, k + 1), self.dims, self.id_col, self.vector
        shared = self.df.sparkSession.sparkContext.broadcast([(r["query_id"], list(map(float, r["query_vector"]))) for r in queries.select("query_id", "query_vector").collect()])

        def walk(rows: pd.DataFrame) -> pd.DataFrame:
            graph, ids = SmallWorld.of(rows, dims, m, ef, vector), rows.sort_values("place", kind="stable")[id_col].tolist()
            out = [(name, ids[i], s) for name, q in shared.value for s, i in graph.find(np.array(q), k + 1, ef) if ids[i] != name]
            return pd.DataFrame(out, columns=["query_id", "id", "similarity"])

        kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {self.df.schema[id_col].dataType.simpleString()}, similarity double"
        return _ranked(self.df.groupBy("part").applyInPandas(walk, kinds), k)

    def stats(self) -> DataFrame:
        links = F.aggregate(F.col("near"), F.lit(0), lambda a, x: a + F.size(x))
        return self.df.agg(F.count(F.lit(1)).alias("vectors"), F.count_distinct("part").alias("parts"), F.max("layer").alias("top_layer"), F.sum(links).alias("links"))


class SmallWorld:
    """A hierarchical navigable small world over the rows of a matrix, by cosine."""

    def __init__(self, x: np.ndarray, m: int, ef: int) -> None:
        norm = np.sqrt((x * x).sum(1)) if len(x) else np.zeros(0)
        self.x, self.m, self.ef = np.nan_to_num(x / np.where(norm > 0, norm, 1)[:, None]), m, ef
        self.layers: list[int] = []
        self.near: list[list[list[int]]] = []

    @classmethod
    def of(cls, rows: pd.DataFrame, dims: int, m: int, ef: int, vector: str) -> SmallWorld:
        """The graph that was stored as rows (place, layer, near, vector)."""
        rows = rows.sort_values("place", kind="stable").reset_index(drop=True)
        place = {int(p): i for i, p in enumerate(rows["place"])}  # deleted ones leave gaps
        graph = cls(np.array(rows[vector].tolist(), dtype=np.float64).reshape(len(rows), dims), m, ef)
        graph.layers = rows["layer"].tolist()
        graph.near = [[[place[int(x)] for x in layer if int(x) in place] for layer in near] for near in rows["near"]]
        return graph

    def _enter(self) -> int:
        return int(np.argmax(self.layers))

    def _beam(self, q: np.ndarray, start: list[int], layer: int, ef: int) -> list[tuple[float, int]]:
        """The ``ef`` best that a best-first walk on one layer meets, best first."""
        seen = set(start)
        sims = self.x[start] @ q
        todo = [(-s, i) for s, i in zip(sims.tolist(), start)]
        best = [(s, i) for s, i in zip(sims.tolist(), start)]
        heapq.heapify(todo)
        heapq.heapify(best)
        while todo:
            s, i = heapq.heappop(todo)
            if len(best) >= ef and -s < best[0][0]:
                break
            fresh = [j for j in (self.near[i][layer] if layer < len(self.near[i]) else ()) if j not in seen]
            seen.update(fresh)
            for sim, j in zip((self.x[fresh] @ q).tolist() if fresh else (), fresh):
                if len(best) < ef or sim > best[0][0]:
                    heapq.heappush(todo, (-sim, j))
                    heapq.heappush(best, (sim, j))
                    if len(best) > ef:
                        heapq.heappop(best)
        return sorted(best, reverse=True)

    def _spread(self, q: int, found: list[tuple[float, int]], most: int) -> list[int]:
        """Up to ``most`` neighbours of ``q``, those that are nearer to it than to one that was taken first."""
        taken: list[int] = []
        for s, i in found:
            if i != q and all(self.x[i] @ self.x[j] <= s for j in taken):
                taken.append(i)
                if len(taken) == most:
                    break
        rest = [i for _, i in found if i != q and i not in taken]
        return taken + rest[: most - len(taken)]

    def build(self, layers: np.ndarray) -> None:
        """Inserts the rows in their order; those of the highest layers should come first."""
        top = -1
        for i, layer in enumerate(layers.tolist()):
            self.layers.append(layer)
            self.near.append([[] for _ in range(layer + 1)])
            if i == 0:
                top = layer
                continue
            start = [int(np.argmax(self.layers[:i]))]
            for at in range(top, layer, -1):
                start = [self._beam(self.x[i], start, at, 1)[0][1]]
            for at in range(min(top, layer), -1, -1):
                found = self._beam(self.x[i], start, at, self.ef)
                most = self.m if at else 2 * self.m
                self.near[i][at] = self._spread(i, found, self.m)
                for j in self.near[i][at]:
                    links = [*self.near[j][at], i]
                    if len(links) > most:
                        sims = self.x[links] @ self.x[j]
                        links = self._spread(j, sorted(zip(sims.tolist(), links), reverse=True), most)
                    self.near[j][at] = links
                start = [k for _, k in found]
            top = max(top, layer)

    def find(self, q: np.ndarray, k: int, ef: int) -> list[tuple[float, int]]:
        if not len(self.x):
            return []
        norm = float(np.sqrt(q @ q)) or 1.0
        start = [self._enter()]
        for at in range(max(self.layers), 0, -1):
            start = [self._beam(q / norm, start, at, 1)[0][1]]
        return self._beam(q / norm, start, 0, ef)[:k]


class Switch:
    """Answers by one index until ``to`` names another that is ready; the one before is kept to go back to."""

    def __init__(self, index: Index) -> None:
        self.current, self.before = index, None

    def to(self, index: Index) -> Switch:
        if index.df is None:
            raise ValueError("the index has not been fitted")
        self.current, self.before = index, self.current
        return self

    def back(self) -> Switch:
        if self.before is not None:
            self.current, self.before = self.before, self.current
        return self

    def search(self, query: Sequence[float], k: int) -> DataFrame:
        return self.current.search(query, k)


def migrate(index: Index, name: str, **options) -> Index:
    """Another strategy fitted on the rows of ``index``."""
    return create(name, id_col=index.id_col, vector=index.vector, dims=index.dims, **options).fit(index.df.select(index.id_col, index.vector))


STRATEGIES: dict[str, type[Index]] = {"exact": ExactIndex, "centroid": ExactIndex, "hnsw": HnswIndex, "ivf": IvfIndex, "pq": PqIndex, "binary": BinaryIndex, "quantized": CellIndex}


def create(name: str, **options) -> Index:
    """A strategy by name."""
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}; one of {sorted(STRATEGIES)}")
    return STRATEGIES[name](**options)


def recommend(n_vectors: int, memory_tight: bool = False) -> str:
    """A strategy for a collection of ``n_vectors``."""
    if n_vectors < 10_000:
        return "exact"
    return "pq" if memory_tight else "ivf"


def recall(found: DataFrame, truth: DataFrame, id_col: str = "id") -> float:
    """Share of the rows of ``truth`` that ``found`` has."""
    n = truth.count()
    return truth.join(found.select(id_col), id_col, "left_semi").count() / n if n else 1.0
