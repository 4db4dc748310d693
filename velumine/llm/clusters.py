"""Similarity clusters (problem 3): sparse affinities, power iteration, k-means of the embedding, exact repair, typical members.

Affinities, vectors. Cells are the dense regions of a bounded sample, found again among the records that no cell holds as long
as that labels many. Two vectors within half the threshold's angle of a cell's centre are similar by the triangle inequality,
and so is a vector with a member of the cell it was compared with: such records share the cell's label, with no pair written.
What is left to compare follows exactly from angles: a record visits a cell it does not belong to only if its angle to the
centre is at most the threshold's angle and the cell's radius. Records without a cell stand in inverted lists and visit each
other's lists by the same bound. Blocks return affinities between labels, not pairs of records, so a cell may hold a third of
all records.

Affinities, word sets. Records of equal sets are one; MinHash bands bring candidates together, and all sets of a band's key are
compared exactly: pair by pair where they are few, else in blocks that return a spanning forest of what is similar. A pair at
the threshold shares a band with probability 0.99, at 0.65 with 0.9996; a cluster is lost only if every link that holds it
together is.

Clusters. The affinities get a loop at each node and are row-normalised, and several vectors are iterated over them,
distributed, with the least label met so far (``power_iteration``). Where the iteration has settled, a vector is constant on a
cluster and differs between clusters. k-means clusters this embedding, with a centre for every occupied cell of a grid over it, so
that centres are as many as the data need. A cluster of the embedding stands if an exact check finds it connected (its nodes
have met one label, which is one of them) and closed (no link leaves it). Those that fail, as long chains do, whose iteration
has not settled, are put together from the labels met, each of which is connected, by the links between them. ``repairs``
counts them. Members are ranked by their affinity inside the cluster: vectors by its leading vector, word sets by the mean
similarity of their links.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velumine.llm import vectors as V
from velumine.operators.relational import top_per_key
from velumine.session import Workspace, spread

#: Vectors the cells are found in, the least size of a cell there, and landmarks kept of each.
SAMPLE, CELL, LANDMARKS = 8_000, 4, 64
#: Rows of a block on either side of a comparison.
BLOCK = 8_192
#: Residents of a cell farthest from its centre, which records are compared with on the spot: a few far ones do not widen the
#: reach of all others.
RIM = 32


# ---------------------------------------------------------------------------------------------------- graph


def components(edges: DataFrame, workspace: Workspace) -> DataFrame:
    """(t, node, component) of the nodes of ``edges`` (t, a, b): the least node reachable, for each graph ``t`` by itself.

    It goes on until no label moves. The node that is a label takes the least label met by the nodes that bear it, so that
    whole trees move at once and the rounds grow with the logarithm of the nodes, not with the length of a chain.
    """
    both = edges.select("t", "a", "b").unionByName(edges.select("t", F.col("b").alias("a"), F.col("a").alias("b")))
    both = workspace.keep(both.filter("a <> b").distinct())
    state = workspace.keep(both.select("t", F.col("a").alias("node")).distinct().withColumn("component", F.col("node")))
    moved = 1
    while moved:
        near = both.join(state.withColumnRenamed("node", "b"), ["t", "b"]).groupBy("t", F.col("a").alias("node")).agg(F.min("component").alias("_m"))
        step = state.join(near, ["t", "node"]).select("t", "node", F.col("component").alias("_was"), F.least("component", "_m").alias("component"), "_m")
        # A label is itself a node: it takes the least label its bearers have met.
        hook = step.groupBy("t", F.col("_was").alias("node")).agg(F.min("_m").alias("_least"))
        step = workspace.keep(step.join(hook, ["t", "node"], "left").select("t", "node", "_was", F.least("component", "_least").alias("component")))
        # Jumping to the label's own label halves the way that is left.
        jump = step.select("t", F.col("node").alias("component"), F.col("component").alias("_c"))
        step = workspace.keep(step.join(jump, ["t", "component"]).select("t", "node", "_was", F.least("component", "_c").alias("component")))
        moved = step.filter("_was <> component").limit(1).count()
        state = step.drop("_was")
    return state


#: Rounds and vectors of the power iteration; a node's loop as a part of its links' weight, which keeps stars from swinging;
#: width of the grid over the embedding.
ROUNDS, VECTORS, LOOP, WIDTH = 6, 4, 0.5, 0.02


def power_iteration(edges: DataFrame, workspace: Workspace, rounds: int = ROUNDS, vectors: int = VECTORS) -> tuple[DataFrame, DataFrame]:
    """(t, node, label, e1 ...) of the nodes of ``edges`` (t, a, b, w): the least label met in so many rounds and the logarithms
    of the iterated vectors. Also the graph iterated over: links both ways, and a loop at each node."""
    both = edges.select("t", "a", "b", "w").unionByName(edges.select("t", F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    both = both.filter("a <> b").groupBy("t", "a", "b").agg(F.max("w").alias("w"))
    loops = both.groupBy("t", "a").agg((F.sum("w") * LOOP).alias("w")).select("t", "a", F.col("a").alias("b"), "w")
    both = workspace.keep(both.unionByName(loops))
    names = [f"v{k}" for k in range(1, vectors + 1)]
    start = lambda k: 0.1 - F.log((F.pmod(F.xxhash64("t", "node", F.lit(k)), F.lit(999_983)) + 1) / 999_983.0)
    state = both.filter("a = b").select("t", F.col("a").alias("node")).select("t", "node", F.col("node").alias("label"), *[start(k).alias(n) for k, n in enumerate(names)])
    for _ in range(rounds):
        met = both.join(state.withColumnRenamed("node", "b"), ["t", "b"])
        total = F.sum("w")
        state = workspace.keep(met.groupBy("t", F.col("a").alias("node")).agg(F.min("label").alias("label"), *[(F.sum(F.col("w") * F.col(n)) / total).alias(n) for n in names]))
    return state.select("t", "node", "label", *[F.log(n).alias(n.replace("v", "e")) for n in names]), both


def embedding_clusters(state: DataFrame, workspace: Workspace, width: float = WIDTH) -> DataFrame:
    """(t, node, label, part): k-means of the embedding. Its centres are the means of the occupied cells of a grid, those within
    a cell's width of each other as one; a node goes to the nearest centre in its own and the neighbouring cells. Neighbours
    are found by the first three coordinates."""
    names = [c for c in state.columns if c.startswith("e")]
    cells = [f"g{n}" for n in names]
    on = ["t", *cells[:3]]
    nodes = state.select("*", *[F.floor(F.col(n) / width + 0.5).alias(c) for n, c in zip(names, cells)])
    centres = workspace.keep(nodes.groupBy("t", *cells).agg(*[F.avg(n).alias(f"c{n}") for n in names]).withColumn("part", F.xxhash64("t", *cells)))
    around = centres.drop(*cells[3:])
    for c in cells[:3]:  # each centre is known in its cell and the cells around
        around = around.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    apart = lambda a, b: sum((F.col(f"{a}{n}") - F.col(f"{b}{n}")) * (F.col(f"{a}{n}") - F.col(f"{b}{n}")) for n in names)
    here = centres.select(*on, F.col("part").alias("_of"), *[F.col(f"c{n}").alias(f"h{n}") for n in names])
    one = here.join(around, on).filter(apart("h", "c") < width * width).groupBy("_of").agg(F.min("part").alias("_one"))
    near = nodes.join(around, on).groupBy("t", "node", "label").agg(F.min(F.struct(apart("", "c").alias("d"), F.col("part").alias("_of"))).alias("_b"))
    return workspace.keep(near.select("t", "node", "label", F.col("_b._of").alias("_of")).join(one, "_of").select("t", "node", "label", F.col("_one").alias("part")))


class Clusters:
    """The clusters of one or more graphs ``t`` of affinities."""

    def __init__(self, edges: DataFrame, workspace: Workspace, rounds: int = ROUNDS) -> None:
        state, both = power_iteration(edges, workspace, rounds)
        parts = embedding_clusters(state, workspace)
        end = lambda c: parts.select("t", F.col("node").alias(c), F.col("label").alias(f"_l{c}"), F.col("part").alias(f"_p{c}"))
        links = both.filter("a < b").select("t", "a", "b").join(end("a"), ["t", "a"]).join(end("b"), ["t", "b"])
        open_ = workspace.keep(links.filter("_la <> _lb or _pa <> _pb").select("t", "_la", "_lb", "_pa", "_pb").distinct())
        # Connected: one label, which is a node of the part.
        own = parts.filter("node = label").select("t", "label", F.col("part").alias("_own"))
        seen = parts.groupBy("t", "part").agg(F.min("label").alias("label"), F.max("label").alias("_high"))
        split = seen.join(own, ["t", "label"], "left").filter("label <> _high or _own is null or _own <> part").select("t", "part")
        leaks = open_.filter("_pa <> _pb")
        bad = split.unionByName(leaks.select("t", F.col("_pa").alias("part"))).unionByName(leaks.select("t", F.col("_pb").alias("part"))).distinct()
        #: (t, part): clusters of the embedding that the exact check does not let stand.
        self.failed = workspace.keep(bad)
        self._parts = parts
        joins = components(open_.filter("_la <> _lb").select("t", F.col("_la").alias("a"), F.col("_lb").alias("b")), workspace)
        repaired = joins.select("t", F.col("node").alias("label"), "component")
        marked = parts.join(self.failed.withColumn("repaired", F.lit(True)), ["t", "part"], "left")
        #: (t, node, component, repaired): a cluster of the embedding bears the label that all its nodes have met.
        self.nodes = marked.join(repaired, ["t", "label"], "left").select("t", "node", F.coalesce("component", "label").alias("component"), F.coalesce("repaired", F.lit(False)).alias("repaired"))

    def repairs(self) -> DataFrame:
        """(t, clusters, failed): clusters of the embedding and those of them that were repaired."""
        failed = self.failed.groupBy("t").agg(F.count(F.lit(1)).alias("_f"))
        every = self._parts.groupBy("t").agg(F.count_distinct("part").alias("clusters"))
        return every.join(failed, "t", "left").select("t", "clusters", F.coalesce("_f", F.lit(0)).alias("failed"))


def _forest(hit: np.ndarray, score: np.ndarray) -> list[tuple[int, int, float]]:
    """A spanning forest of the bipartite graph whose links are ``hit``; columns are counted after the rows."""
    row, col = np.nonzero(hit)
    up = list(range(sum(hit.shape)))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for i, j in zip(row.tolist(), col.tolist()):
        a, b = top(i), top(hit.shape[0] + j)
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((i, j, float(score[i, j])))
    return out


# ---------------------------------------------------------------------------------------------------- vectors


def find_cells(x: np.ndarray, least: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """(centres, landmarks of each) of the components of at least CELL vectors in the graph of ``x`` at ``least``."""
    free = np.ones(len(x), dtype=bool)
    centres, marks = [], []
    inner = math.sqrt((1 + least) / 2)
    for i in range(len(x)):
        if not free[i]:
            continue
        members, front = [i], np.array([i])
        free[i] = False
        while len(front):
            open_ = np.flatnonzero(free)
            if not len(open_):
                break
            near = open_[(x[open_] @ x[front[:512]].T >= least).any(1)]
            free[near] = False
            members += near.tolist()
            front = np.concatenate([front[512:], near])
        if len(members) < CELL:
            continue
        m = x[members]
        c = m.mean(0)
        c /= np.linalg.norm(c)
        close = m[m @ c >= inner + 1e-5]
        if len(close):
            centres.append(c)
            marks.append(close[:LANDMARKS].copy())
    dim = x.shape[1] if x.ndim == 2 else 0
    return np.array(centres, dtype=np.float32).reshape(-1, dim), marks


class VectorClusters:
    """Clusters of records whose vectors are linked by chains of cosines of at least ``least``."""

    def __init__(self, rows: DataFrame, workspace: Workspace, least: float = 0.7, dim: int = 64, sample_size: int = SAMPLE) -> None:
        self.work, self.least, self.dim, self.sample_size = workspace, least, dim, sample_size
        loose, total = rows.select("_rid", "_id", "_v"), rows.count()
        self.centres = np.zeros((0, dim), dtype=np.float32)
        done: list[DataFrame] = []
        while True:
            centres, marks = find_cells(V.sample(loose, total, sample_size, dim), least)
            labelled = workspace.keep(self._labelled(loose, centres, marks, len(self.centres)))
            self.centres = np.concatenate([self.centres, centres])
            loose, left = labelled.filter("_cell < 0").select("_rid", "_id", "_v"), labelled.filter("_cell < 0").count()
            done.append(labelled.filter("_cell >= 0"))
            # Another level costs a pass over the records without a cell; it stops where that labels few of them.
            if not len(centres) or not left or total - left < total / 10:
                break
            total = left
        self.n_cells, self.n_loose = len(self.centres), left
        cells = done[0]
        for d in done[1:]:
            cells = cells.unionByName(d)
        #: (_rid, _id, _v, _cell, _cos): the cell is -1 for records without one.
        self.rows = cells.unionByName(labelled.filter("_cell < 0"))
        self.edges = workspace.keep(self._cell_links(cells).unionByName(self._loose_links(loose)))

    def _labelled(self, rows: DataFrame, centres: np.ndarray, marks: list[np.ndarray], first: int) -> DataFrame:
        """``rows`` with the cell, counted from ``first``, and the cosine to its centre."""
        shared = rows.sparkSession.sparkContext.broadcast((centres, marks))
        least, dim, inner = self.least, self.dim, math.sqrt((1 + self.least) / 2) + 1e-5

        def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, landmarks = shared.value
            for b in batches:
                x = V.unpack(b.column(2), dim)
                cell, cos = np.full(len(x), -1, dtype=np.int32), np.full(len(x), -1.0, dtype=np.float32)
                if len(c) and len(x):
                    at, best = V.nearest(x, c)
                    for k in np.unique(at):
                        of = np.flatnonzero(at == k)
                        mine = best[of] >= inner
                        mine[~mine] = (x[of[~mine]] @ landmarks[k].T >= least + 1e-6).any(1)
                        cell[of[mine]], cos[of[mine]] = first + k, best[of[mine]]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(cell), pa.array(cos)], names=["_rid", "_id", "_v", "_cell", "_cos"])

        return rows.mapInArrow(label, "_rid long, _id string, _v binary, _cell int, _cos float")

    def _cell_links(self, cells: DataFrame) -> DataFrame:
        """Affinities between the labels of records and the cells they may reach. A label is a cell's number or the record's,
        counted after the cells."""
        there = cells.select("_rid", "_v", "_cell", "_cos", F.col("_cell").cast("long").alias("_label"))
        going = self.rows.select("_rid", "_v", "_cell", self._label().alias("_label"))
        return self._met(going, there, self.centres, own=False)

    def _loose_links(self, loose: DataFrame) -> DataFrame:
        """Affinities among records without a cell: each stands in the inverted list of its nearest centroid and visits the
        lists it may reach."""
        dim, sample = self.dim, V.sample(loose, self.n_loose, self.sample_size, self.dim)
        lists = V.spherical_kmeans(sample, int(max(1, min(len(sample) // 8, 4 * self.n_loose // BLOCK))))
        shared = loose.sparkSession.sparkContext.broadcast(lists)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, cos = V.nearest(V.unpack(b.column(1), dim), shared.value) if len(shared.value) else (np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.float32))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at.astype(np.int32)), pa.array(cos)], names=["_rid", "_v", "_cell", "_cos"])

        rows = loose.select("_rid", "_v").mapInArrow(place, "_rid long, _v binary, _cell int, _cos float")
        rows = self.work.keep(rows.withColumn("_label", F.col("_rid") + self.n_cells))
        return self._met(rows.drop("_cos"), rows, lists, own=True)

    def _label(self) -> Column:
        return F.when(F.col("_cell") >= 0, F.col("_cell").cast("long")).otherwise(F.col("_rid") + self.n_cells)

    def _met(self, going: DataFrame, there: DataFrame, centres: np.ndarray, own: bool) -> DataFrame:
        """(a, b, w) among the labels of visitors and residents of similar vectors, a spanning forest of those of a block.

        Of two places the one of the lesser number visits; ``own`` lets the residents of one place meet each other too.
        """
        spark, least, dim, k = there.sparkSession, self.least, self.dim, len(centres)
        count = there.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per centre
        far = top_per_key(there.select("_cell", "_rid", "_cos"), ["_cell"], [F.asc("_cos"), F.asc("_rid")], RIM + 1, salt="_rid", parts=4)
        far = there.join(F.broadcast(self.work.keep(far.select("_rid"))), "_rid", "left_semi").select("_cell", "_rid", "_label", "_cos", "_v").toArrow()  # RIM + 1 rows of a centre
        # The least cosine to a centre at which a resident that is not of its rim can be in reach.
        reach, parts = np.full(k, 2.0), np.ones(k, dtype=np.int64)
        rim: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros((0, dim), np.float32), np.zeros(0, np.int64)) for _ in range(k)]
        where, cos, tags, rids = (far.column(c).to_numpy() for c in ("_cell", "_cos", "_label", "_rid"))
        vectors, inner = V.unpack(far.column("_v"), dim), np.full(k, -1.0)
        for r in count:
            c, mine = r["_cell"], np.flatnonzero(where == r["_cell"])
            mine = mine[np.lexsort((rids[mine], cos[mine]))]
            rim[c] = vectors[mine[:RIM]], tags[mine[:RIM]]
            if r["n"] > RIM:
                inner[c] = cos[mine[RIM]]
                reach[c] = math.cos(min(math.pi, math.acos(least) + math.acos(max(-1.0, min(1.0, inner[c] - 1e-5))))) - 1e-5
            parts[c] = max(1, -(-r["n"] // BLOCK))
        shared = spark.sparkContext.broadcast((centres, reach, parts, rim))

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, floor, n_parts, far_ones = shared.value
            names = ["_label", "_other", "_v", "_w", "_cell", "_part", "_vb"]
            for b in batches:
                if not len(c):
                    continue
                x, rid, mine, label = V.unpack(b.column(1), dim), b.column(0).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy()
                s = x @ c.T
                order = np.arange(len(c))[None, :] - mine[:, None]
                may = order >= 0 if own else order > 0
                # Far residents are met here: (visitor's label, theirs, cosine).
                links = []
                for k_, (y, tag) in enumerate(far_ones):
                    if len(y):
                        at, j = np.nonzero((x @ y.T >= least) & may[:, k_, None] & (label[:, None] != tag[None, :]))
                        links.append(np.stack([label[at], tag[j]], 1))
                links = np.unique(np.concatenate(links), axis=0) if links else np.zeros((0, 2), np.int64)
                n = len(links)
                yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1]), pa.nulls(n, pa.binary()), pa.array(np.full(n, least)), *[pa.nulls(n, pa.int32())] * 3], names=names)
                i, cell = np.nonzero(may & (s >= floor[None, :]))
                angle = s[i, cell].astype(np.float64)
                n = n_parts[cell]
                angle = np.repeat(angle, n)
                i, cell, first = np.repeat(i, n), np.repeat(cell, n), np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([pa.array(label[i]), pa.nulls(len(i), pa.int64()), b.column(1).take(pa.array(i)), pa.array(angle), pa.array(cell.astype(np.int32)), pa.array((np.arange(len(i)) - first).astype(np.int32)), pa.array((rid[i] % 4096).astype(np.int32))], names=names)

        gone = self.work.keep(going.select("_rid", "_v", "_cell", "_label").mapInArrow(visit, "_label long, _other long, _v binary, _w double, _cell int, _part int, _vb int"))
        links = gone.filter("_other is not null").select(F.col("_label").alias("a"), F.col("_other").alias("b"), "_w")
        visits = gone.filter("_other is null")
        blocks = visits.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / F.max(F.col("_part") + 1) / BLOCK).cast("int").alias("_nb"), F.max("_w").alias("_near"))
        visits = visits.join(blocks.drop("_near"), "_cell").withColumn("_vb", F.pmod("_vb", "_nb"))
        many = F.array(*[F.lit(int(p)) for p in parts]) if k else F.array(F.lit(1))
        # Residents nearer to the centre than the nearest visitor can reach stay at home.
        homely = F.acos(F.least(F.lit(1.0), F.col("_cos").cast("double"))) + 1e-4 + math.acos(least) >= F.acos(F.least(F.lit(1.0), F.col("_near")))
        residents = there.join(blocks, "_cell").filter(homely).withColumn("_part", F.pmod(F.xxhash64("_rid"), F.get(many, F.col("_cell"))).cast("int")).withColumn("_vb", F.explode(F.expr("sequence(0, _nb - 1)")))
        names = {"_label": "_rl", "_v": "_rv", "_cell": "_rc", "_part": "_rp", "_vb": "_rb"}  # apart from the visitors' columns
        residents = residents.select(*[F.col(c).alias(n) for c, n in names.items()])

        def meet(visitors: pa.Table, residents: pa.Table) -> pa.Table:
            out: list[tuple[int, int, float]] = []
            if len(visitors) and len(residents):
                x, y = V.unpack(visitors.column("_v"), dim), V.unpack(residents.column("_rv"), dim)
                tag, other = visitors.column("_label").to_numpy(), residents.column("_rl").to_numpy()
                alike = bool((other == other[0]).all())
                for i in range(0, len(x), 256):
                    s, mine = x[i : i + 256] @ y.T, tag[i : i + 256]
                    if alike:
                        best = s.max(1)
                        out += [(int(other[0]), int(mine[j]), float(best[j])) for j in np.flatnonzero(best >= least)]
                        continue
                    hit = (s >= least) & (mine[:, None] != other[None, :])
                    if hit.any():
                        r, c = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
                        out += [(int(mine[r[a]]), int(other[c[b]]), w) for a, b, w in _forest(hit[np.ix_(r, c)], s[np.ix_(r, c)])]
            cols = list(zip(*out)) if out else [[], [], []]
            return pa.table({"a": pa.array(cols[0], pa.int64()), "b": pa.array(cols[1], pa.int64()), "w": pa.array(cols[2], pa.float64())})

        visits = visits.select("_label", "_v", "_cell", "_part", "_vb")
        found = visits.groupBy("_cell", "_part", "_vb").cogroup(residents.groupBy("_rc", "_rp", "_rb")).applyInArrow(meet, "a long, b long, w double")
        return found.unionByName(links.withColumnRenamed("_w", "w")).groupBy("a", "b").agg(F.max("w").alias("w"))

    def members(self, size: int, found: DataFrame | None = None) -> DataFrame:
        """(_rid, item_id, cluster, cluster_id, size, repaired, _v) of the records in clusters of at least ``size``. ``found``
        has the clusters (node, component, repaired) where several graphs were clustered at once."""
        found = Clusters(self.edges.withColumn("t", F.lit(0)), self.work).nodes if found is None else found
        linked = found.select(F.col("node").alias("_label"), "component", "repaired")
        rows = self.rows.withColumn("_label", self._label()).join(linked, "_label", "left").withColumn("cluster", F.coalesce("component", "_label"))
        known = rows.groupBy("cluster").agg(F.min("_id").alias("cluster_id"), F.count(F.lit(1)).alias("size")).filter(F.col("size") >= size)
        return rows.join(known, "cluster").select("_rid", F.col("_id").alias("item_id"), "cluster", "cluster_id", "size", F.coalesce("repaired", F.lit(False)).alias("repaired"), "_v")

    def affinity(self, members: DataFrame, rounds: int = 2) -> DataFrame:
        """(item_id, cluster_id, size, affinity): the weight of each member in the leading vector of its cluster's affinity
        matrix, by power iteration. The product of the matrix with a vector is two passes over the members through one sum
        of ``dim`` numbers per cluster, since affinities are products of vectors; its first round gives the degrees."""
        dim = self.dim
        members = self.work.keep(members.drop("repaired").withColumn("weight", F.lit(1.0)))
        for _ in range(rounds):
            def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                held: dict[str, np.ndarray] = {}
                for b in batches:
                    x, w = V.unpack(b.column(1), dim).astype(np.float64), b.column(2).to_numpy()
                    ids, at = np.unique(b.column(0).to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
                    part = np.zeros((len(ids), dim))
                    np.add.at(part, at, x * w[:, None])
                    for i, k in enumerate(ids):
                        held[k] = held.get(k, 0) + part[i]
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))], names=["cluster_id", "_s"])

            partial = members.select("cluster_id", "_v", "weight").mapInArrow(sums, "cluster_id string, _s array<double>")
            total = partial.select("cluster_id", F.posexplode("_s")).groupBy("cluster_id", "pos").agg(F.sum("col").alias("c"))
            total = total.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("pos", "c"))).alias("_t")).select("cluster_id", F.transform("_t", lambda t: t["c"]).alias("_sum"))

            def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    x = V.unpack(b.column(5), dim).astype(np.float64)
                    s = b.column(7).flatten().to_numpy().reshape(-1, dim)
                    n = b.column(4).to_numpy()
                    yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(6)), pa.array((x * s).sum(1) / n)], names=["_rid", "item_id", "cluster", "cluster_id", "size", "_v", "weight"])

            cols = ["_rid", "item_id", "cluster", "cluster_id", "size", "_v", "weight"]
            joined = members.join(total, "cluster_id").select(*cols, "_sum")
            members = self.work.keep(joined.mapInArrow(weigh, "_rid long, item_id string, cluster long, cluster_id string, size long, _v binary, weight double"))
        return members.select("item_id", "cluster_id", "size", F.round("weight", 6).alias("affinity"))


# ---------------------------------------------------------------------------------------------------- word sets

_WORDS = re.compile(r"[a-z0-9]+")
#: MinHash rows and bands; the distance to which neighbours of a band's key are paired one by one. Keys of more than NEAR + 1
#: sets are compared in blocks of HOT.
ROWS, BANDS, NEAR, HOT = 6, 100, 31, 2_048


def word_hashes(words: set[str]) -> np.ndarray:
    """Sorted 32-bit hashes of distinct words."""
    import xxhash

    return np.unique(np.array([xxhash.xxh32_intdigest(w) for w in words], dtype=np.uint32))


def band_keys(sets: list[np.ndarray], rows: int = ROWS, bands: int = BANDS, seed: int = 11) -> np.ndarray:
    """(sets, bands) keys of the MinHash bands."""
    rng = np.random.default_rng(seed)
    n = rows * bands
    mul = (rng.integers(1, 1 << 62, n, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
    add = rng.integers(0, 1 << 62, n, dtype=np.uint64)
    flat = np.concatenate(sets)
    words, at = np.unique(flat, return_inverse=True)
    perm = ((words.astype(np.uint64)[:, None] * mul[None, :] + add[None, :]) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    low = np.empty((len(sets), n), dtype=np.uint32)
    for i in range(0, len(sets), 256):
        end = starts[i + 256] if i + 256 < len(sets) else len(flat)
        low[i : i + 256] = np.minimum.reduceat(perm[at[starts[i] : end]], starts[i : i + 256] - starts[i], axis=0)
    key = np.zeros((len(sets), bands), dtype=np.uint64)
    parts = low.reshape(len(sets), bands, rows)
    for r in range(rows):
        key = (key ^ parts[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    # 44 bits are enough to tell bands apart (what meets by chance is compared anyway) and travel in fewer bytes.
    return (key + np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)


#: Bits of a sketch of a set, and the bits in which the sketches of a pair at the threshold of 0.6 agree less than by chance:
#: five standard deviations below their mean, which one such pair in three million falls short of.
SKETCH, AGREE = 256, 173


def sketches(sets: list[np.ndarray], seed: int = 23) -> np.ndarray:
    """(sets, SKETCH / 8) bytes: the lowest bit of the least of each of SKETCH hashes. Two sketches agree in a bit with
    probability (1 + similarity) / 2."""
    rng = np.random.default_rng(seed)
    mul = (rng.integers(1, 1 << 62, SKETCH, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
    add = rng.integers(0, 1 << 62, SKETCH, dtype=np.uint64)
    flat = np.concatenate(sets)
    words, at = np.unique(flat, return_inverse=True)
    perm = ((words.astype(np.uint64)[:, None] * mul[None, :] + add[None, :]) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    low = np.empty((len(sets), SKETCH), dtype=np.uint32)
    for i in range(0, len(sets), 256):
        end = starts[i + 256] if i + 256 < len(sets) else len(flat)
        low[i : i + 256] = np.minimum.reduceat(perm[at[starts[i] : end]], starts[i : i + 256] - starts[i], axis=0)
    low ^= low >> np.uint32(15)
    return np.packbits((low & 1).astype(bool), axis=1)


def similar_sets(sets: list[np.ndarray], least: float, pivots: int = 64, width: int = 2_048) -> list[tuple[int, int]]:
    """A spanning forest (i, j) of the graph of all pairs of ``sets`` with a Jaccard similarity of ``least``.

    A few sets are compared with all first. Pairs inside the largest component they make need no comparison; every other
    pair is compared, by products of the 0/1 matrix of the words that stand in several sets.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(n), size)
    _, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    use = often[at] > 1
    row, at = row[use], np.unique(at[use], return_inverse=True)[1]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out: list[tuple[int, int]] = []

    def compare(these: np.ndarray) -> None:
        shared = np.zeros((len(these), n), dtype=np.float32)
        for lo in range(0, int(at[-1]) + 1 if len(at) else 0, width):
            a, z = np.searchsorted(at, [lo, lo + width])
            has = np.zeros((n, width), dtype=np.float32)
            has[row[a:z], at[a:z] - lo] = 1
            shared += has[these] @ has.T
        for i in range(0, len(these), 64):
            part, both = these[i : i + 64], shared[i : i + 64].astype(np.float64)
            all_ = size[part][:, None] + size[None, :] - both
            label = np.array([top(x) for x in range(n)])
            for r, c in np.argwhere((both >= least * all_ - 1e-9) & (label[part][:, None] != label[None, :])).tolist():
                a, b = top(int(part[r])), top(c)
                if a != b:
                    up[max(a, b)] = min(a, b)
                    out.append((int(part[r]), c))

    compare(np.unique(np.linspace(0, n - 1, min(n, pivots)).astype(int)))
    label = np.array([top(x) for x in range(n)])
    rest = np.flatnonzero(label != np.bincount(label).argmax())
    if len(rest):
        compare(rest)
    return out


class WordClusters:
    """Clusters of records whose sets of words are linked by chains of Jaccard similarities of at least ``least``."""

    def __init__(self, df: DataFrame, workspace: Workspace, least: float = 0.6, fewest: int = 20) -> None:
        """``df`` has (_id, _text). Records with fewer than ``fewest`` distinct words take no part."""
        self.work, self.least = workspace, least

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep, sets = [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    words = set(_WORDS.findall(t.lower()))
                    if len(words) >= fewest:
                        keep.append(i)
                        sets.append(word_hashes(words).tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(sets, pa.binary())], names=["_id", "_set"])

        rows = spread(df.select("_id", "_text").filter("_text is not null and _id is not null")).mapInArrow(read, "_id string, _set binary")
        size = F.least(F.lit(255), F.octet_length("_set") / 4).cast("long")
        rows = workspace.keep(rows.withColumn("_key", F.shiftleft(F.shiftright(F.xxhash64("_set"), 8), 8) + size))
        #: (_id, _key): the key stands for the set; its lowest byte is the set's size, up to 255. Of the rows of an id the
        #: least key counts.
        self.rows = workspace.keep(rows.groupBy("_id").agg(F.min("_key").alias("_key")))
        self.sets = workspace.keep(rows.select("_key", "_set").dropDuplicates(["_key"]).join(self.rows.select("_key").distinct(), "_key", "left_semi"))
        self.edges = workspace.keep(self._edges())

    def _edges(self) -> DataFrame:
        least = self.least

        def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys = b.column(0).to_numpy()
                raw = b.column(1).to_pylist()
                for i in range(0, len(raw), 2048):
                    got = band_keys([np.frombuffer(s, dtype=np.uint32) for s in raw[i : i + 2048]])
                    yield pa.RecordBatch.from_arrays([pa.array(got.reshape(-1).view(np.int64)), pa.array(np.repeat(keys[i : i + 2048], got.shape[1]))], names=["_band", "_key"])

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tail_band, tail_key = np.zeros(0, np.int64), np.zeros(0, np.int64)
            last, length, held = None, 0, np.zeros(0, np.int64)  # the run that may go on: band, length, keys while it is short
            for b in batches:
                band, key_ = b.column(0).to_numpy(), b.column(1).to_numpy()
                if not len(band):
                    continue
                # Runs too long for pairs of neighbours go on whole.
                first = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
                long = np.diff(np.r_[first, len(band)])
                total = long.copy()
                goes_on = last is not None and last == band[0]
                total[0] += length if goes_on else 0
                hot = np.flatnonzero(np.repeat(total > NEAR + 1, long))
                hot_band, hot_key = band[hot], key_[hot]
                if goes_on and total[0] > NEAR + 1:
                    hot_band, hot_key = np.r_[np.full(len(held), last), hot_band], np.r_[held, hot_key]
                before = held if goes_on and len(first) == 1 else np.zeros(0, np.int64)
                last, length = band[-1], int(total[-1])
                held = np.r_[before, key_[first[-1] :]] if length <= NEAR + 1 else np.zeros(0, np.int64)
                if len(hot_key):
                    yield pa.RecordBatch.from_arrays([pa.array(hot_band), pa.array(hot_key), pa.array(np.ones(len(hot_key), bool))], names=["a", "b", "hot"])
                old = len(tail_band)
                band, key_ = np.concatenate([tail_band, band]), np.concatenate([tail_key, key_])
                x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for d in range(1, NEAR + 1):
                    same = np.flatnonzero(band[d:] == band[:-d]) if len(band) > d else np.zeros(0, np.int64)
                    same = same[same + d >= old]
                    if not len(same):
                        break
                    x.append(key_[same])
                    y.append(key_[same + d])
                tail_band, tail_key = band[-NEAR:], key_[-NEAR:]
                a, c = np.concatenate(x), np.concatenate(y)
                a, c = np.minimum(a, c), np.maximum(a, c)
                # Sets of too different sizes can't be similar.
                m, n = np.minimum(a & 255, c & 255), np.maximum(a & 255, c & 255)
                fit = (m >= least * n - 1e-9) | (n == 255)
                a, c = a[fit], c[fit]
                if len(a):
                    u = np.unique(np.stack([a, c], axis=1), axis=0)
                    u = u[u[:, 0] != u[:, 1]]
                    yield pa.RecordBatch.from_arrays([pa.array(u[:, 0]), pa.array(u[:, 1]), pa.array(np.zeros(len(u), bool))], names=["a", "b", "hot"])

        banded = self.sets.mapInArrow(bands, "_band long, _key long")
        met = self.work.keep(banded.repartition("_band").sortWithinPartitions("_band", "_key").mapInArrow(pairs, "a long, b long, hot boolean"))
        hot = self._hot(met.filter("hot").select(F.col("a").alias("_band"), F.col("b").alias("_key")))
        near = met.filter("not hot").select("a", "b").unionByName(hot).repartition("a").distinct()
        def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                raw = b.column(1).to_pylist()
                for i in range(0, len(raw), 2048):
                    part = sketches([np.frombuffer(s, dtype=np.uint32) for s in raw[i : i + 2048]])
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(part)), V.pack(part)], names=["_key", "_sk"])

        def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, y = (V.unpack_bytes(b.column(i), SKETCH // 8) for i in (2, 3))
                same = SKETCH - np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
                take = pa.array(np.flatnonzero(same >= AGREE))
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take)], names=["a", "b"])

        # Most candidates meet by chance; sketches of a few bytes drop them before the sets themselves travel.
        short = self.work.keep(self.sets.mapInArrow(sketch, "_key long, _sk binary"))
        by = lambda df, c, s: df.select(F.col("_key").alias(c), F.col(s).alias(f"{s}_{c}"))
        drawn = near.join(by(short, "a", "_sk"), "a").join(by(short, "b", "_sk"), "b").select("a", "b", "_sk_a", "_sk_b")
        close = self.work.keep(drawn.mapInArrow(agree, "a long, b long"))
        both = close.join(by(self.sets, "a", "_set"), "a").join(by(self.sets, "b", "_set"), "b").select("a", "b", "_set_a", "_set_b")

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                w = np.zeros(b.num_rows)
                for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                    m, n = len(x) // 4, len(y) // 4
                    if min(m, n) < least * max(m, n) - 1e-9:
                        continue
                    both_ = np.sort(np.concatenate([np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)]))
                    shared = int((both_[1:] == both_[:-1]).sum())
                    if shared >= least * (m + n - shared) - 1e-9:
                        w[i] = shared / (m + n - shared)
                hit = pa.array(np.flatnonzero(w > 0))
                yield pa.RecordBatch.from_arrays([b.column(0).take(hit), b.column(1).take(hit), pa.array(w[w > 0])], names=["a", "b", "w"])

        return both.mapInArrow(check, "a long, b long, w double")

    def _hot(self, rows: DataFrame) -> DataFrame:
        """Links among all sets (_band, _key) of the bands' keys that many share, compared in blocks of HOT by HOT."""
        least = self.least
        blocks = rows.groupBy("_band").agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("_nb"))
        rows = rows.join(blocks, "_band").withColumn("_mine", F.pmod(F.xxhash64("_key"), "_nb").cast("int"))
        # Two blocks meet as one group, inside each as well.
        rows = rows.withColumn("_other", F.explode(F.expr("filter(sequence(0, _nb - 1), x -> x <> _mine or _nb = 1)")))
        rows = rows.select("_band", "_key", F.least("_mine", "_other").alias("_lo"), F.greatest("_mine", "_other").alias("_hi")).join(self.sets, "_key")

        def meet(group: pa.Table) -> pa.Table:
            keys = group.column("_key").to_pylist()
            links = similar_sets([np.frombuffer(s, np.uint32) for s in group.column("_set").to_pylist()], least)
            a = [min(keys[i], keys[j]) for i, j in links]
            b = [max(keys[i], keys[j]) for i, j in links]
            return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        return rows.groupBy("_band", "_lo", "_hi").applyInArrow(meet, "a long, b long")

    def members(self, size: int, found: DataFrame | None = None) -> DataFrame:
        """(item_id, cluster_id, size, affinity) of the records in clusters of at least ``size``. A record's affinity is the
        mean similarity of its links; records of one set are linked fully. ``found`` as for vectors."""
        found = Clusters(self.edges.withColumn("t", F.lit(0)), self.work).nodes if found is None else found
        found = found.select(F.col("node").alias("_key"), "component")
        both = self.edges.select(F.col("a").alias("_key"), "w").unionByName(self.edges.select(F.col("b").alias("_key"), "w"))
        weight = both.groupBy("_key").agg(F.avg("w").alias("_w"))
        rows = self.rows.select("_id", "_key").join(found, "_key", "left").withColumn("cluster", F.coalesce("component", "_key"))
        known = rows.groupBy("cluster").agg(F.min("_id").alias("cluster_id"), F.count(F.lit(1)).alias("size")).filter(F.col("size") >= size)
        out = rows.join(known, "cluster").join(weight, "_key", "left")
        return out.select(F.col("_id").alias("item_id"), "cluster_id", "size", F.round(F.coalesce("_w", F.lit(1.0)), 6).alias("affinity"))


def describe(members: DataFrame, top: int = 3) -> DataFrame:
    """(cluster_id, size, typical): each cluster with its most typical members, by affinity and then id."""
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("affinity")).alias("_n"), "item_id"))), 1, top)
    # Salted first, so that no group holds a large cluster: only `top` members of each part meet.
    part = members.withColumn("_p", F.pmod(F.xxhash64("item_id"), F.lit(64)))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("cluster_id", "_p").orderBy(F.desc("affinity"), "item_id"))
    few = part.withColumn("_r", rank).filter(F.col("_r") <= top)
    return few.groupBy("cluster_id").agg(F.max("size").alias("size"), best.alias("_t")).select("cluster_id", "size", F.transform("_t", lambda t: t["item_id"]).alias("typical"))
