"""Most similar vectors for every vector (problem 7): an inverted file with product-quantised residuals and exact reranking.

Coarse centroids and codebooks are fitted on a bounded sample of vectors; every vector is indexed. Where a sample can't give as
many centroids as the collection needs lists, the residuals are quantised again, by words that all lists share, so that the
number of lists grows with the collection without an end (``Lists``). Near lists form groups of bounded size, the unit of
work; a group that holds more is salted into parts. A query goes to the groups of the lists it probes; one that asks for all
vectors of at least some cosine goes to every group that can hold one, which distances tell exactly. There, approximate
similarities are its asymmetric distance tables against the codes: the sums over all code places are taken as one product of
the query with the decoded residuals, plus its product with the coarse centroid, which are the same numbers. The best of them
are reranked by the exact vectors. Groups of queries are cut into blocks too, so that neither side of a task grows with the
data.

Recall is measured by the tests against brute force. Ties are broken by id. Null, short, zero and non-finite vectors are not
indexed and ask nothing. A collection of one vector gives no neighbours.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velumine.llm import vectors as V
from velumine.operators.relational import top_per_key
from velumine.session import Workspace


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the vectors that models are fitted on; a list has about ``list_rows`` vectors; a query probes up to
    ``probes`` lists whose centroid is within ``margin`` of the nearest one's cosine; ``rerank`` candidates of a group part
    are compared exactly. ``words`` bounds the centroids of one level of the lists, not the lists."""

    dim: int = 64
    sample: int = 30_000
    list_rows: int = 300
    words: int = 2048
    group_rows: int = 8_000
    part_rows: int = 16_000
    query_rows: int = 60_000
    probes: int = 96
    margin: float = 0.35
    places: int = 32
    rerank: int = 48


class Lists:
    """Inverted lists: a vector's list is the nearest coarse centroid, the nearest word to what that leaves, and so on, for as
    many levels as it takes to have about ``want`` lists. Lists of one group share the groups of their centroids and words.

    Vectors farther than ``edge`` from their coarse centroid have groups of their own, by coarse centroid alone: they are few and
    have many centroids about as near, so a query among them would visit all groups otherwise. ``edge`` stands where the
    distances of the sample are thinnest.
    """

    def __init__(self, x: np.ndarray, want: int, words: int, groups: int) -> None:
        self.levels: list[np.ndarray] = []
        self.group_of: list[np.ndarray] = []  # group of each word, by level
        self.share: list[np.ndarray] = []  # part of the sample with each word, by level
        rest, lists, most = x, 1, max(1, min(words, len(x) // 4))
        while len(x) and (not self.levels or lists < want):
            k = int(min(most, max(1, -(-want // lists))))
            c = V.spherical_kmeans(rest, k) if not self.levels else V.codebooks(rest, 1, words=k)[0]
            at = V.nearest(rest, c)[0] if not self.levels else V.quantise_part(rest, c)
            g = int(min(len(c), max(1, -(-groups // self.n_inner))))
            heads = V.spherical_kmeans(c, g) if not self.levels else V.codebooks(c, 1, words=g)[0]
            self.group_of.append(V.nearest(c, heads)[0] if not self.levels else V.quantise_part(c, heads))
            self.share.append(np.bincount(at, minlength=len(c)) / max(1, len(at)))
            self.levels.append(c)
            rest, lists = rest - c[at], lists * len(c)
            if len(self.levels) == 1:
                away = np.sqrt((rest * rest).sum(1))
                at_most = np.quantile(away, np.linspace(0.5, 0.99, 50))
                near = [(np.abs(away - t) <= 0.1).mean() for t in at_most]
                self.edge = float(at_most[int(np.argmin(near))])
                out = away > self.edge
                heads = V.spherical_kmeans(c, int(min(len(c), max(1, math.ceil(groups * out.mean())))))
                self.outer_of = V.nearest(c, heads)[0]
                self.outer_share = np.bincount(self.outer_of[at[out]], minlength=int(self.outer_of.max()) + 1) / len(at)
                inner = np.bincount(at[~out], minlength=len(c)) / len(at)
                self.share[0] = inner
            if len(c) < 2:
                break

    @property
    def n_inner(self) -> int:
        return math.prod(int(g.max()) + 1 for g in self.group_of)

    @property
    def n_groups(self) -> int:
        return self.n_inner + (len(self.outer_share) if self.levels else 0)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, centroid, group) of each vector."""
        at, group, centroid = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), np.zeros_like(x)
        for n, (c, g) in enumerate(zip(self.levels, self.group_of)):
            i = V.nearest(x, c)[0] if not n else V.quantise_part(x - centroid, c)
            if not n:
                out, outer = np.sqrt(((x - c[i]) ** 2).sum(1)) > self.edge, self.outer_of[i]
            at, group, centroid = at * len(c) + i, group * (int(g.max()) + 1) + g[i], centroid + c[i]
        return at, centroid, np.where(out, self.n_inner + outer, group) if self.levels else group

    def centroids(self, at: np.ndarray) -> np.ndarray:
        """The centroids of lists."""
        out = np.zeros((len(at), self.levels[0].shape[1] if self.levels else 0), np.float32)
        for c in reversed(self.levels):
            at, i = at // len(c), at % len(c)
            out += c[i]
        return out

    def probe(self, x: np.ndarray, probes: int, margin: float, enough: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, group) of the groups each row of ``x`` visits: those of up to ``probes`` best lists within ``margin`` of the
        best, and of more where those hold fewer than a part ``enough`` of all."""
        c, g, share = self.levels[0], self.group_of[0], self.share[0]
        s = x @ c.T
        few = min(len(c), probes)
        at = np.argpartition(s, -few, axis=1)[:, -few:] if few < len(c) else np.tile(np.arange(len(c)), (len(x), 1))
        short = np.flatnonzero(share[at].sum(1) < enough)  # rows whose best lists hold too little go through all
        row = np.r_[np.repeat(np.arange(len(x)), few), np.repeat(short, len(c))]
        at = np.r_[at.reshape(-1), np.tile(np.arange(len(c)), len(short))]
        once = np.ones(len(row), bool)
        once[: len(x) * few] = ~np.isin(row[: len(x) * few], short)
        row, at = row[once], at[once]
        share = share + self.outer_share[self.outer_of] / np.bincount(self.outer_of)[self.outer_of]
        row, at, size, score = _best_of(row, at, share[at], s[row, at], len(x), probes, margin, enough)
        beyond, group = np.unique(row * np.int64(self.n_groups) + self.n_inner + self.outer_of[at]), g[at]
        for c, g, share in zip(self.levels[1:], self.group_of[1:], self.share[1:]):
            t = x @ c.T
            n = len(c)
            score = (score[:, None] + t[row]).reshape(-1)
            group = (group[:, None] * (int(g.max()) + 1) + g[None, :]).reshape(-1)
            size = (size[:, None] * share[None, :]).reshape(-1)
            row = np.repeat(row, n)
            row, group, size, score = _best_of(row, group, size, score, len(x), probes, margin, enough)
        pairs = np.union1d(row * np.int64(self.n_groups) + group, beyond)
        return pairs // self.n_groups, pairs % self.n_groups

    def reach(self, x: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, group) of every group that holds a vector of a cosine of at least ``floor`` with a row of ``x``.

        Such a vector is at most e away from the row, so its nearest word is at most 2 e farther from the row than the row's own
        nearest one, and its distance to that word differs by at most e from the row's to its own. That holds at every level, for
        the rests that the words before leave, and leaves no list out.
        """
        e = math.sqrt(max(0.0, 2 - 2 * floor)) + 1e-3
        row, group, centroid = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros((len(x), x.shape[1]), np.float32)
        beyond = np.zeros(0, np.int64)
        for n, (c, g) in enumerate(zip(self.levels, self.group_of)):
            rows, groups, centroids, outer = [], [], [], []
            for i in range(0, len(row), 2048):
                part = slice(i, i + 2048)
                rest = x[row[part]] - centroid[part]
                d = np.sqrt(np.maximum(0, (rest * rest).sum(1)[:, None] - 2 * rest @ c.T + (c * c).sum(1)[None, :]))
                best = d.min(1)
                r, at = np.nonzero(d <= best[:, None] + 2 * e)
                if not n:
                    far = best[r] + e >= self.edge
                    outer.append(row[part][r[far]] * np.int64(self.n_groups) + self.n_inner + self.outer_of[at[far]])
                    near = best[r] - e <= self.edge
                    r, at = r[near], at[near]
                rows.append(row[part][r])
                groups.append(group[part][r] * (int(g.max()) + 1) + g[at])
                centroids.append(centroid[part][r] + c[at])
            if not n:
                beyond = np.concatenate([beyond, *outer])
            row, group = np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *groups])
            centroid = np.concatenate([np.zeros((0, x.shape[1]), np.float32), *centroids])
        pairs = np.union1d(row * np.int64(self.n_groups) + group, beyond)
        return pairs // self.n_groups, pairs % self.n_groups

    def shares(self, group: np.ndarray) -> np.ndarray:
        """The part of all vectors that groups hold, by the sample."""
        if not self.levels:
            return np.ones(len(group))
        beyond, outside = group - self.n_inner, group >= self.n_inner
        out = np.ones(len(group))
        for g, share in zip(reversed(self.group_of), reversed(self.share)):
            n = int(g.max()) + 1
            out *= np.bincount(g, weights=share, minlength=n)[group % n]
            group = group // n
        out[outside] = self.outer_share[beyond[outside]]
        return out


def _best_of(row: np.ndarray, group: np.ndarray, size: np.ndarray, score: np.ndarray, rows: int, probes: int, margin: float, enough: float) -> tuple[np.ndarray, ...]:
    """The lists that rows go to, of candidates (row, group, size, score) that stand by row."""
    order = np.lexsort((-score, row))
    row, group, size, score = row[order], group[order], size[order], score[order]
    first = np.searchsorted(row, np.arange(rows))
    rank = np.arange(len(row)) - first[row]
    sums = np.cumsum(size)
    before = sums - size - (sums[first] - size[first])[row]
    keep = (rank < probes) & (score >= score[first][row] - margin) | (before < enough)
    return row[keep], group[keep], size[keep], score[keep]


@dataclass(frozen=True)
class _Cut:
    """How groups are cut: parts of the stored vectors and blocks of the queries."""

    total: int
    part_rows: int
    query_rows: int

    def of(self, group: np.ndarray, lists: Lists) -> tuple[np.ndarray, np.ndarray]:
        rows = lists.shares(group) * self.total
        return np.maximum(1, np.ceil(rows / self.part_rows)).astype(np.int64), np.maximum(1, np.ceil(rows / self.query_rows)).astype(np.int64)


class VectorIndex:
    """An index over one collection; ``scope`` keeps vectors of different scopes apart."""

    def __init__(self, df: DataFrame, workspace: Workspace, id_col: Column, vector_col: str, scope: Column | None = None, settings: Settings = Settings()) -> None:
        self.s, self.work = settings, workspace
        #: Every indexed record: (_id, _scope, _v, _rid).
        self.rows = V.usable(df, workspace, id_col, vector_col, settings.dim, scope)
        self.spark = self.rows.sparkSession
        # Equal vectors are searched once, by their 64-bit hash, however many records have them.
        keyed = self.rows.select("_rid", "_scope", F.xxhash64("_v").alias("_k"))
        first = keyed.groupBy("_scope", "_k").agg(F.min("_rid").alias("_first"))
        #: (_rid, _first): the record that stands for each record's vector.
        self.classes = workspace.keep(keyed.join(first, ["_scope", "_k"]).select("_rid", "_first"))
        # Kept, so that its size is known to the planner and vectors need not be shuffled where it is small.
        copies = workspace.keep(self.classes.filter("_rid <> _first").select("_rid"))
        self.distinct = self.rows.join(copies, "_rid", "left_anti")
        self.total = self.distinct.count()
        x = V.sample(self.distinct, self.total, settings.sample, settings.dim)
        self.lists = Lists(x, max(1, self.total // settings.list_rows), settings.words, max(1, math.ceil(self.total / settings.group_rows)))
        empty = np.zeros((settings.places, 1, settings.dim // settings.places), np.float32)
        self.books = V.codebooks(x - self.lists.place(x)[1], settings.places) if len(x) else empty

    def _stored(self) -> DataFrame:
        """Every vector with its group, part, list and codes, once for each block of the group's queries."""
        lists, books = self.spark.sparkContext.broadcast(self.lists), self.spark.sparkContext.broadcast(self.books)
        dim, cut = self.s.dim, _Cut(self.total, self.s.part_rows, self.s.query_rows)

        def run(batches):
            for b in batches:
                x = V.unpack(b.column(2), dim)
                of, centroid, g = lists.value.place(x)
                codes = V.quantise(x - centroid, books.value)
                rid = b.column(0).to_numpy()
                parts, blocks = cut.of(g, lists.value)
                part = (rid * np.int64(0x9E3779B1) >> 7) % parts
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(of), V.pack(codes), pa.array(g), pa.array(part.astype(np.int32)), pa.array(blocks.astype(np.int32))], names=["_rid", "_scope", "_v", "_list", "_codes", "_g", "_part", "_nb"])

        rows = self.distinct.select("_rid", "_scope", "_v").mapInArrow(run, "_rid long, _scope string, _v binary, _list long, _codes binary, _g long, _part int, _nb int")
        return rows.withColumn("_qb", F.explode(F.expr("sequence(0, _nb - 1)"))).drop("_nb")

    def _asked(self, queries: DataFrame, floor: float | None) -> DataFrame:
        """Every query in each group part that it visits."""
        lists = self.spark.sparkContext.broadcast(self.lists)
        dim, probes, margin, cut = self.s.dim, self.s.probes, self.s.margin, _Cut(self.total, self.s.part_rows, self.s.query_rows)
        enough = self.s.rerank / max(1, self.total)

        def run(batches):
            for b in batches:
                x = V.unpack(b.column(2), dim)
                rid = b.column(0).to_numpy()
                if not lists.value.levels:
                    continue
                for i in range(0, len(x), 1024):
                    part = x[i : i + 1024]
                    q, g = lists.value.probe(part, probes, margin, enough) if floor is None else lists.value.reach(part, floor)
                    n, blocks = cut.of(g, lists.value)
                    q, g, blocks, first = np.repeat(q, n), np.repeat(g, n), np.repeat(blocks, n), np.repeat(np.cumsum(n) - n, n)
                    part = np.arange(len(q)) - first
                    take = pa.array(q + i)
                    block = (rid[q + i] * np.int64(0x85EBCA6B) >> 9) % blocks
                    yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), b.column(2).take(take), pa.array(g), pa.array(part.astype(np.int32)), pa.array(block.astype(np.int32))], names=["_rid", "_scope", "_v", "_g", "_part", "_qb"])

        return queries.select("_rid", "_scope", "_v").mapInArrow(run, "_rid long, _scope string, _v binary, _g long, _part int, _qb int")

    def neighbours(self, queries: DataFrame, k: int = 10, floor: float | None = None) -> DataFrame:
        """(_rid, _other, _sim): the ``k`` most similar other records of each query row, of at least ``floor``.

        ``queries`` are rows of the index. Records of one vector share its search; a vector's records take part with their
        ``k`` + 1 least numbers, more than which no result can hold.
        """
        every = queries is self.rows
        asked = self.classes if every else self.classes.join(queries.select("_rid"), "_rid", "left_semi")
        stand = self.distinct if every else self.distinct.join(asked.select(F.col("_first").alias("_rid")).distinct(), "_rid", "left_semi")
        # Kept, so that the driver plans the search and the joins of its records one after the other, not as one large plan.
        found = self.work.keep(self._search(stand, k, floor)).select(F.col("_rid").alias("_first"), F.col("_other").alias("_c"), "_sim")
        copies = self.work.keep(self.classes.filter("_rid <> _first").select("_first").distinct())
        own = copies.select("_first", F.col("_first").alias("_c"), F.lit(1.0).alias("_sim"))
        few = top_per_key(self.classes.join(copies, "_first", "left_semi"), ["_first"], [F.asc("_rid")], k + 1, salt="_rid").select(F.col("_first").alias("_c"), F.col("_rid").alias("_m"))
        pairs = found.unionByName(own).join(few, "_c", "left").select("_first", F.coalesce("_m", "_c").alias("_other"), "_sim")
        out = asked.join(pairs, "_first").filter("_rid <> _other")
        rank = F.row_number().over(Window.partitionBy("_rid").orderBy(F.desc("_sim"), "_other"))  # at most (k + 1) squared rows
        return out.select("_rid", "_other", "_sim", rank.alias("_n")).filter(F.col("_n") <= k).drop("_n")

    def _search(self, queries: DataFrame, k: int, floor: float | None) -> DataFrame:
        """The same over distinct vectors."""
        lists, books = self.spark.sparkContext.broadcast(self.lists), self.spark.sparkContext.broadcast(self.books)
        dim, rerank = self.s.dim, max(self.s.rerank, 2 * k)
        low = -2.0 if floor is None else float(floor)

        def probe(asked: pa.Table, stored: pa.Table) -> pa.Table:
            q, x = V.unpack(asked.column("_v"), dim), V.unpack(stored.column("_v"), dim)
            rid, other = asked.column("_rid").to_numpy(), stored.column("_rid").to_numpy()
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            if len(x):
                codes = V.unpack_bytes(stored.column("_codes"), books.value.shape[0])
                approx = np.ascontiguousarray((lists.value.centroids(stored.column("_list").to_numpy()) + V.decode(codes, books.value)).T)
                # A product differs from its approximation by at most the length of what quantisation left out.
                near = low - np.linalg.norm(x - approx.T, axis=1).astype(np.float32) - 1e-5
                for i in range(0, len(q), 512):
                    part = q[i : i + 512]
                    s = part @ approx
                    row, col = np.nonzero(s >= near) if low > -1 else best_places(s, rerank)
                    keep = rid[i + row] != other[col]
                    row, col = row[keep], col[keep]
                    sim = np.einsum("ij,ij->i", part[row].astype(np.float64), x[col].astype(np.float64))
                    if low > -1:
                        high = sim >= low
                        row, col, sim = row[high], col[high], sim[high]
                    order = np.lexsort((other[col], -sim, row))
                    row, col, sim = row[order], col[order], sim[order]
                    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
                    nth = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
                    top = nth < k
                    out.append((rid[i + row[top]], other[col[top]], sim[top]))
            a, b, c = (np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            return pa.table({"_rid": pa.array(a, pa.int64()), "_other": pa.array(b, pa.int64()), "_sim": pa.array(c, pa.float64())})

        by = ["_scope", "_g", "_part", "_qb"]
        found = self._asked(queries, floor).groupBy(*by).cogroup(self._stored().groupBy(*by)).applyInArrow(probe, "_rid long, _other long, _sim double")
        # At most k rows of each visited part come together for a query.
        best = found.groupBy("_rid").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("_sim")).alias("_neg"), "_other"))), 1, k).alias("_top"))
        return best.select("_rid", F.explode("_top").alias("_t")).select("_rid", F.col("_t._other").alias("_other"), (-F.col("_t._neg")).alias("_sim"))

    def named(self, found: DataFrame, first: str = "id", second: str = "neighbour_id") -> DataFrame:
        """``found`` with ids instead of numbers."""
        a = self.rows.select("_rid", F.col("_id").alias(first))
        b = self.rows.select(F.col("_rid").alias("_other"), F.col("_id").alias(second))
        return found.join(a, "_rid").join(b, "_other").select(first, second, F.col("_sim").alias("similarity"))


def best_places(s: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of at least the ``most`` greatest values of each row.

    The least of the ``most`` greatest maxima of runs of columns bounds them from below, which saves sorting whole rows.
    """
    n = s.shape[1]
    run = 32
    if n < 2 * most * 2:
        if n <= most:
            row, col = np.divmod(np.arange(s.size), n)
            return row, col
        bound = np.partition(s, n - most, axis=1)[:, n - most]
    else:
        run = min(run, n // (2 * most))
        whole = n // run * run
        maxima = s[:, :whole].reshape(len(s), -1, run).max(2)
        bound = np.partition(maxima, maxima.shape[1] - most, axis=1)[:, maxima.shape[1] - most]
    return np.nonzero(s >= bound[:, None])
