"""Parent-child links to full hierarchies (problem 6).

1. Records are numbered as they are written, and parents are found by their keys in full, so no hash is trusted.
2. Pointers are doubled until no record reaches a root any more, which brings the records of a tree together: as many rounds as
   the logarithm of the greatest depth.
3. Trees are numbered as nested sets: subtree sizes upward, then preorder ranges of siblings by prefix sums downward, which
   give depths, roots and paths on the way. Trees of up to ``tree_rows`` records are numbered many to a task, level by level
   in arrays. Larger ones are walked around as one list (into a record, through its children, out of it), whose places and
   depths are sums over the rest of the list; these are taken by doubling too, so that rounds grow with the logarithm of the
   records, no task holds a whole large tree, and a parent may have any number of children.
4. Records left without a range are on or below a cycle. They get the least id on it, by doubling among themselves alone.

A record's ancestors and descendants then follow from ranges: d is below a if they have one root and lft(a) < lft(d) < rgt(a).

A record whose parent is null, blank or no record of the table is a root. A record in several rows counts once, by its id
(the least parent, if rows differ). Ids and parents are compared without surrounding white space. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velumine.functions.text import key
from velumine.session import Workspace

TREE_ROWS = 50_000
_TREE = "table_name string, item_id string, root_id string, depth int, path string, lft long, rgt long, descendants long"


def links(df: DataFrame, table_name: str, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """(table_name, item_id, parent_id) with one row per record."""
    rows = df.select(key(id_col).alias("item_id"), key(parent_col).alias("parent_id")).filter("item_id is not null")
    return rows.groupBy("item_id").agg(F.min("parent_id").alias("parent_id")).select(F.lit(table_name).alias("table_name"), "item_id", "parent_id")


class Forest:
    """The hierarchy of one or more tables of links."""

    def __init__(self, rows: DataFrame, workspace: Workspace, tree_rows: int = TREE_ROWS) -> None:
        self.work, self.tree_rows = workspace, tree_rows
        base = workspace.keep(rows.withColumn("_h", F.monotonically_increasing_id()))
        above = base.select("table_name", F.col("item_id").alias("parent_id"), F.col("_h").alias("_p"))
        #: (table_name, item_id, _h, _p): the record's number and its parent's, which is null for roots.
        self.nodes = workspace.keep(base.join(above, ["table_name", "parent_id"], "left").select("table_name", "item_id", "_h", "_p"))
        self._settle()

    def _settle(self) -> None:
        """Doubles pointers until no more records reach a root: (_h, _root) of those that do, and the rest."""
        done = self.nodes.filter("_p is null").select("_h", F.col("_h").alias("_a"))
        active = self.nodes.filter("_p is not null").select("_h", F.col("_p").alias("_a"))
        left = active.count()
        while left:
            every = done.select(F.col("_h").alias("_k"), F.col("_a").alias("_a2"), F.lit(True).alias("_end"))
            every = every.unionByName(active.select(F.col("_h").alias("_k"), F.col("_a").alias("_a2"), F.lit(False).alias("_end")))
            step = active.join(every, active["_a"] == every["_k"]).select("_h", F.col("_a2").alias("_a"), "_end")
            step = self.work.keep(step)
            now = step.filter("not _end").count()
            done = done.unionByName(step.filter("_end").drop("_end"))
            active = step.filter("not _end").drop("_end")
            if now == left:
                break
            left = now
        self.settled = done.select("_h", F.col("_a").alias("_root"))
        self.cyclic, self.n_cyclic = active.select("_h"), left

    def cycles(self) -> DataFrame:
        """(table_name, item_id, root_id, depth -1) of the records on or below a cycle."""
        c = self.nodes.join(self.cyclic, "_h", "left_semi").select("_h", F.col("_p").alias("_a"), F.col("item_id").alias("_m"))
        c = self.work.keep(c)
        reach = 1
        while reach < self.n_cyclic:
            to = c.select(F.col("_h").alias("_k"), F.col("_a").alias("_a2"), F.col("_m").alias("_m2"))
            c = self.work.keep(c.join(to, c["_a"] == to["_k"]).select("_h", F.col("_a2").alias("_a"), F.least("_m", "_m2").alias("_m")))
            reach *= 2
        # After as many steps as there are records every pointer is on its cycle, and the least id from there on is the cycle's.
        on = c.select(F.col("_h").alias("_k"), F.col("_m").alias("root_id"))
        found = c.select("_h", "_a").join(on, F.col("_a") == F.col("_k")).select("_h", "root_id")
        return self.nodes.join(found, "_h").select("table_name", "item_id", "root_id", F.lit(-1).cast("int").alias("depth"))

    def trees(self) -> DataFrame:
        """(table_name, item_id, root_id, depth, path, lft, rgt, descendants) of all records that reach a root."""
        rows = self.nodes.join(self.settled, "_h")
        sizes = self.settled.groupBy("_root").agg(F.count(F.lit(1)).alias("_n"))
        rows = self.work.keep(rows.join(sizes, "_root"))
        limit, total = self.tree_rows, rows.count()
        buckets = max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // limit))
        small = rows.filter(F.col("_n") <= limit).withColumn("_b", F.pmod(F.xxhash64("_root"), F.lit(buckets)))
        out = small.select("_b", "table_name", "item_id", "_h", "_p").groupBy("_b").applyInArrow(_number, _TREE)
        large = rows.filter(F.col("_n") > limit)
        return out if large.isEmpty() else out.unionByName(self._number_large(large))

    def _number_large(self, rows: DataFrame) -> DataFrame:
        keep = self.work.keep
        # Siblings are ordered in parts of the range of their ids; the last of a part is followed by the first of the next.
        kids = keep(rows.filter("_p is not null").select("_h", "_p", "item_id").repartitionByRange("_p", "item_id").withColumn("_part", F.spark_partition_id()))
        heads = kids.groupBy("_p", "_part").agg(F.min_by("_h", "item_id").alias("_head"))
        heads = heads.withColumn("_then", F.lead("_head").over(Window.partitionBy("_p").orderBy("_part")))
        after = F.lead("_h").over(Window.partitionBy("_p", "_part").orderBy("item_id"))
        siblings = kids.withColumn("_after", after).join(heads, ["_p", "_part"]).select("_h", F.coalesce("_after", "_then").alias("_after"))
        eldest = heads.groupBy(F.col("_p").alias("_h")).agg(F.min_by("_head", "_part").alias("_first"))
        into, out = lambda c: F.col(c) * 2, lambda c: F.col(c) * 2 + 1  # noqa: E731  elements of the list
        walk = rows.select("_h", "_p").join(siblings, "_h", "left").join(eldest, "_h", "left")
        enter = walk.select(into("_h").alias("_e"), F.coalesce(into("_first"), out("_h")).alias("_to"), F.lit(1).cast("long").alias("_s"))
        leave = walk.select(out("_h").alias("_e"), F.coalesce(into("_after"), out("_p")).alias("_to"), F.lit(-1).cast("long").alias("_s"))
        # (_e, _to, _c, _s): the place behind what has been summed, how many elements that was, and their steps down less up.
        going = keep(enter.unionByName(leave).withColumn("_c", F.lit(1).cast("long")))
        while not going.filter("_to is not null").isEmpty():
            next_ = going.select(F.col("_e").alias("_to"), F.col("_to").alias("_to2"), F.col("_c").alias("_c2"), F.col("_s").alias("_s2"))
            ahead, there = going.filter("_to is not null"), going.filter("_to is null")
            ahead = ahead.join(next_, "_to").select("_e", F.col("_to2").alias("_to"), (F.col("_c") + F.col("_c2")).alias("_c"), (F.col("_s") + F.col("_s2")).alias("_s"))
            going = keep(ahead.unionByName(there.select("_e", "_to", "_c", "_s")))
        ends = going.select(F.floor(F.col("_e") / 2).alias("_h"), F.when(F.col("_e") % 2 == 0, F.col("_c")).alias("_ci"), F.when(F.col("_e") % 2 == 1, F.col("_c")).alias("_co"), F.when(F.col("_e") % 2 == 0, -F.col("_s")).alias("_d"))
        ends = ends.groupBy("_h").agg(F.max("_ci").alias("_ci"), F.max("_co").alias("_co"), F.max("_d").cast("int").alias("depth"))
        # Paths by doubling as well: the ids from below the pointer to the record.
        path = keep(rows.select("_h", F.col("_p").alias("_a"), F.col("item_id").alias("path")))
        while not path.filter("_a is not null").isEmpty():
            above = path.select(F.col("_h").alias("_a"), F.col("_a").alias("_a2"), F.col("path").alias("_above"))
            more = path.filter("_a is not null").join(above, "_a").select("_h", F.col("_a2").alias("_a"), F.concat_ws("/", "_above", "path").alias("path"))
            path = keep(more.unionByName(path.filter("_a is null")))
        roots = rows.filter("_p is null").select("_root", F.col("item_id").alias("root_id"))
        full = rows.join(ends, "_h").join(path.select("_h", "path"), "_h").join(roots, "_root")
        whole = F.col("_n") * 2
        full = full.withColumn("lft", whole - F.col("_ci") + 1).withColumn("rgt", whole - F.col("_co") + 1)
        return full.select("table_name", "item_id", "root_id", "depth", "path", "lft", "rgt", F.expr("(rgt - lft - 1) div 2").alias("descendants"))


def _number(rows: pa.Table) -> pa.Table:
    """Nested-set numbers, depths and paths of whole trees, level by level."""
    ids = rows.column("item_id").to_pylist()
    h = rows.column("_h").to_numpy()
    n = len(h)
    by_number = np.argsort(h, kind="stable")
    p = rows.column("_p").fill_null(-1).to_numpy()
    parent = np.where(p >= 0, by_number[np.clip(np.searchsorted(h[by_number], p), 0, max(0, n - 1))], -1)
    # Siblings in order of their ids.
    rank = np.empty(n, dtype=np.int64)
    rank[sorted(range(n), key=ids.__getitem__)] = np.arange(n)
    order = np.lexsort((rank, parent))
    first, last = np.searchsorted(parent[order], np.arange(-1, n)), np.searchsorted(parent[order], np.arange(-1, n), side="right")
    levels = [order[first[0] : last[0]]]  # the roots; each level is the children of the one before
    depth = np.zeros(n, dtype=np.int64)
    while True:
        a, z = first[levels[-1] + 1], last[levels[-1] + 1]
        total = int((z - a).sum())
        if not total:
            break
        spots = np.repeat(a - np.r_[0, np.cumsum(z - a)[:-1]], z - a) + np.arange(total)
        depth[order[spots]] = len(levels)
        levels.append(order[spots])
    size = np.ones(n, dtype=np.int64)
    for level in reversed(levels[1:]):
        np.add.at(size, parent[level], size[level])
    lft = np.ones(n, dtype=np.int64)
    root = np.arange(n)
    path: list[str] = list(ids)
    for level in levels[1:]:
        above = parent[level]
        total = np.cumsum(size[level]) - size[level]
        first = np.flatnonzero(np.r_[True, above[1:] != above[:-1]])
        base = np.repeat(total[first], np.diff(np.r_[first, len(level)]))
        lft[level] = lft[above] + 1 + 2 * (total - base)
        root[level] = root[above]
        for i, a in zip(level.tolist(), above.tolist()):
            path[i] = f"{path[a]}/{ids[i]}"
    roots = pa.array(ids, pa.string()).take(pa.array(root))
    cols = [rows.column("table_name").combine_chunks(), pa.array(ids, pa.string()), roots, pa.array(depth.astype(np.int32)), pa.array(path, pa.string()), pa.array(lft), pa.array(lft + 2 * size - 1), pa.array(size - 1)]
    return pa.Table.from_arrays(cols, names=["table_name", "item_id", "root_id", "depth", "path", "lft", "rgt", "descendants"])


def dyadic(lo: int, hi: int) -> list[tuple[int, int]]:
    """(level, block) of the fewest blocks of 2**level aligned numbers that make up lo..hi."""
    out = []
    level = 0
    hi += 1
    while lo < hi:
        if lo & 1:
            out.append((level, lo))
            lo += 1
        if hi & 1:
            hi -= 1
            out.append((level, hi))
        lo >>= 1
        hi >>= 1
        level += 1
    return out


def descendants(trees: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(table_name, item_id, descendant_id, distance) of the records in ``ancestors``, by their ranges in ``trees``.

    The numbers inside a record's range are cut into aligned blocks, at most two of each power of two; a record has one block
    of each size about its own number. Both sides meet in equal blocks, so the join makes the pairs of the result and no
    others, and a tree of any size is spread over its blocks.
    """
    a = ancestors.filter("descendants > 0").select("table_name", "root_id", "item_id", "depth", "lft", "rgt")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, level, block = [], [], []
            for i, (lo, hi) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist())):
                for lv, bl in dyadic(lo + 1, hi - 1):
                    at.append(i)
                    level.append(lv)
                    block.append(bl)
            rows = b.select(["table_name", "root_id", "item_id", "depth"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(level, pa.int32()), pa.array(block, pa.int64())], names=["table_name", "root_id", "item_id", "depth", "_level", "_block"])

    blocks = a.mapInArrow(cut, "table_name string, root_id string, item_id string, depth int, _level int, _block long")
    most = ancestors.agg(F.max(F.col("rgt") - F.col("lft"))).first()[0] or 1
    spot = trees.filter("depth > 0").select("table_name", "root_id", F.col("item_id").alias("descendant_id"), F.col("depth").alias("_dd"), F.col("lft").alias("_l"), F.explode(F.sequence(F.lit(0), F.lit(int(most).bit_length()))).alias("_level"))
    spot = spot.withColumn("_block", F.call_function("shiftright", "_l", "_level")).drop("_l")
    return blocks.join(spot, ["table_name", "root_id", "_level", "_block"]).select("table_name", "item_id", "descendant_id", (F.col("_dd") - F.col("depth")).alias("distance"))
