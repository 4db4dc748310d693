"""Property-graph operators over one table of nodes and one of edges.

Traversals run as joins level by level. ``walk`` keeps one row per path, as recursive SQL with UNION ALL does; ``reach`` keeps
each node once at its least depth, by an anti join with what was seen. Both start from a stated set and are bounded in depth.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velumine.functions.text import key
from velumine.session import Workspace

MOST_DEPTH = 20
#: The types of edges.
EDGE_TYPES = ("calls", "extends", "implements", "imports", "contains", "references")


class Graph:
    """``nodes`` (id, name, type, file_path, ...) and ``edges`` (source_id, target_id, type, confidence, weight).

    Each node counts once, by its id; each edge once, by (source, target, type). Edges without a key at either end are left
    out; ``valid`` keeps only edges whose ends are nodes.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame) -> None:
        n = nodes.select(key("id").alias("id"), *[F.col(c) for c in nodes.columns if c != "id"]).filter("id is not null")
        n = n.withColumn("type", F.lower(F.btrim("type"))).withColumn("name", F.btrim("name"))
        best = n.groupBy("id").agg(F.min_by(F.struct("name", "type", "file_path", "start_line"), F.struct("created_at", "name")).alias("_n"))
        self.nodes = best.select("id", "_n.*")
        e = edges.select(key("source_id").alias("source_id"), key("target_id").alias("target_id"), F.lower(F.btrim("type")).alias("type"), "confidence", "weight")
        e = e.filter("source_id is not null and target_id is not null")
        self.edges = e.groupBy("source_id", "target_id", "type").agg(F.min("confidence").alias("confidence"), F.max("weight").alias("weight"))

    def valid(self) -> DataFrame:
        """Edges with both ends among the nodes."""
        ids = self.nodes.select("id")
        e = self.edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
        return e.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")

    def resolve(self, name: str) -> DataFrame:
        """Ids of a node given by id, else by name."""
        by_id = self.nodes.filter(F.col("id") == name).select("id")
        by_name = self.nodes.filter(F.col("name") == name).select("id").join(by_id.select(F.lit(1).alias("_x")).limit(1), F.lit(True), "left_anti")
        return by_id.unionByName(by_name)

    def walk(self, start: DataFrame, types: Sequence[str] | None, depth: int, forward: bool = True) -> DataFrame:
        """(start_id, id, depth, path): one row for each path of up to ``depth`` edges."""
        a, b = ("source_id", "target_id") if forward else ("target_id", "source_id")
        e = self.edges if types is None else self.edges.filter(F.col("type").isin(list(types)))
        e = e.select(F.col(a).alias("_from"), F.col(b).alias("_to"))
        level = start.select(F.col("id").alias("start_id"), "id", F.col("id").alias("path"))
        out = None
        for d in range(1, min(depth, MOST_DEPTH) + 1):
            level = level.join(e, F.col("id") == F.col("_from")).select("start_id", F.col("_to").alias("id"), F.concat_ws(" → ", "path", "_to").alias("path"))
            step = level.withColumn("depth", F.lit(d))
            out = step if out is None else out.unionByName(step)
        return out.select("start_id", "id", "depth", "path")

    def callers(self, start: DataFrame, depth: int = 1) -> DataFrame:
        return self.walk(start, ["calls"], depth, forward=False)

    def callees(self, start: DataFrame, depth: int = 1) -> DataFrame:
        return self.walk(start, ["calls"], depth)

    def ancestors(self, start: DataFrame, depth: int = MOST_DEPTH, types: Sequence[str] = ("extends",)) -> DataFrame:
        return self.walk(start, types, depth)

    def descendants(self, start: DataFrame, depth: int = MOST_DEPTH, types: Sequence[str] = ("extends",)) -> DataFrame:
        return self.walk(start, types, depth, forward=False)

    def one_hop(self, start: DataFrame, edge_type: str, forward: bool = True) -> DataFrame:
        """Importers, imports and implementations: neighbours by one type of edge."""
        return self.walk(start, [edge_type], 1, forward)

    def reach(self, start: DataFrame, depth: int, workspace: Workspace, types: Sequence[str] | None = None, direction: str = "out") -> DataFrame:
        """(id, depth): every node within ``depth`` edges of ``start``, at its least depth. direction: out, in or both."""
        e = self.edges if types is None else self.edges.filter(F.col("type").isin(list(types)))
        out, into = e.select(F.col("source_id").alias("_from"), F.col("target_id").alias("_to")), e.select(F.col("target_id").alias("_from"), F.col("source_id").alias("_to"))
        pairs = workspace.keep({"out": out, "in": into, "both": out.unionByName(into)}[direction].distinct())
        seen = front = workspace.keep(start.select("id").distinct().withColumn("depth", F.lit(0)))
        for d in range(1, min(depth, MOST_DEPTH) + 1):
            new = front.join(pairs, front["id"] == pairs["_from"]).select(F.col("_to").alias("id")).distinct().join(seen, "id", "left_anti")
            front = workspace.keep(new.withColumn("depth", F.lit(d)))
            if front.isEmpty():
                break
            seen = seen.unionByName(front)
        return seen

    def dependents(self, start: DataFrame, workspace: Workspace, depth: int = MOST_DEPTH) -> DataFrame:
        """Everything that leads to ``start`` by edges of any type."""
        return self.reach(start, depth, workspace, direction="in").filter("depth > 0")

    def neighborhood(self, start: DataFrame, depth: int, workspace: Workspace) -> tuple[DataFrame, DataFrame]:
        """(nodes with depth, edges among them)."""
        near = self.reach(start, depth, workspace, direction="both")
        ids = near.select("id")
        inside = self.edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
        return near, inside

    def degrees(self) -> DataFrame:
        """(id, in_degree, out_degree) of every node, 0 without edges."""
        o = self.edges.groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
        i = self.edges.groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
        both = self.nodes.select("id", "name", "type", "file_path").join(i, "id", "left").join(o, "id", "left")
        return both.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("in_degree", "out_degree")})

    def god_nodes(self, top: int = 10) -> DataFrame:
        """The functions, methods, modules and classes of greatest degree."""
        d = self.degrees().filter(F.col("type").isin("function", "method", "module", "class")).withColumn("degree", F.col("in_degree") + F.col("out_degree"))
        return d.orderBy(F.desc("degree"), "id").limit(top).select("id", "name", "type", "degree")

    def bridge_nodes(self, top: int = 10, least_files: int = 2) -> DataFrame:
        """Nodes that call into several other files."""
        s = self.nodes.select(F.col("id").alias("source_id"), F.col("file_path").alias("_sf"))
        t = self.nodes.select(F.col("id").alias("target_id"), F.col("file_path").alias("_tf"))
        calls = self.edges.filter("type = 'calls'").join(s, "source_id").join(t, "target_id").filter("_sf <> _tf")
        n = calls.groupBy(F.col("source_id").alias("id")).agg(F.count_distinct("_tf").alias("files")).filter(F.col("files") >= least_files)
        return n.orderBy(F.desc("files"), "id").limit(top)

    def _community(self) -> Column:
        at = F.instr("file_path", "/")
        return F.when(at > 1, F.left(F.col("file_path"), at - 1)).otherwise(F.lit(""))

    def communities(self, least: int = 3) -> DataFrame:
        """(community, nodes, degree, internal_edges, cohesion): nodes by the first segment of their path."""
        d = self.degrees().withColumn("community", self._community()).filter("community <> ''")
        n = d.groupBy("community").agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.col("in_degree") + F.col("out_degree")).alias("degree"), F.sum("out_degree").alias("_out")).filter(F.col("nodes") >= least)
        c = d.select("id", "community")
        s, t = c.select(F.col("id").alias("source_id"), F.col("community").alias("_a")), c.select(F.col("id").alias("target_id"), F.col("community").alias("_b"))
        inner = self.edges.join(s, "source_id").join(t, "target_id").filter("_a = _b").groupBy(F.col("_a").alias("community")).agg(F.count(F.lit(1)).alias("internal_edges"))
        out = n.join(inner, "community", "left").withColumn("internal_edges", F.coalesce("internal_edges", F.lit(0)))
        return out.select("community", "nodes", "degree", "internal_edges", F.round(F.col("internal_edges") / F.greatest(F.col("_out"), F.lit(1)), 3).alias("cohesion"))

    def surprising(self, top: int = 10) -> DataFrame:
        """Inferred, ambiguous or cross-community edges, the least certain first."""
        c = self.nodes.select("id", self._community().alias("_c"))
        s, t = c.select(F.col("id").alias("source_id"), F.col("_c").alias("_a")), c.select(F.col("id").alias("target_id"), F.col("_c").alias("_b"))
        cross = (F.col("_a") != F.col("_b")) & (F.col("_a") != "") & (F.col("_b") != "")
        weak = F.coalesce(F.col("confidence").isin("INFERRED", "AMBIGUOUS"), F.lit(False))
        reason = F.when(F.col("confidence") == "AMBIGUOUS", "ambiguous").when(F.col("confidence") == "INFERRED", "inferred").otherwise("crosses communities")
        order = F.when(F.col("confidence") == "AMBIGUOUS", 0).when(F.col("confidence") == "INFERRED", 1).otherwise(2)
        e = self.edges.join(s, "source_id").join(t, "target_id").filter(weak | cross).withColumn("reason", reason)
        return e.orderBy(order, "source_id", "target_id", "type").limit(top).select("source_id", "target_id", "type", "reason")

    def counts(self) -> DataFrame:
        """(kind, type, n) of nodes and edges."""
        n = self.nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("node"))
        return n.unionByName(self.edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("edge")))

    def report(self, top: int = 10) -> dict[str, DataFrame]:
        """The parts of a report on the graph, and questions that follow from them."""
        gods, bridges = self.god_nodes(top), self.bridge_nodes(top)
        asked = gods.select(F.concat(F.lit("Why do so many parts depend on "), "name", F.lit("?")).alias("question"))
        asked = asked.unionByName(bridges.select(F.concat(F.lit("Does "), "id", F.lit(" belong to one of the files it ties together?")).alias("question")))
        return {"counts": self.counts(), "god_nodes": gods, "bridge_nodes": bridges, "communities": self.communities(), "surprising": self.surprising(top), "questions": asked}

    def pagerank(self, workspace: Workspace, rounds: int = 10, damping: float = 0.85) -> DataFrame:
        """(id, pagerank) of every node. Rank of nodes without outgoing edges is spread over all. Contributions are summed
        before the shuffle, so a hot target costs one row per partition."""
        links = workspace.keep(self.valid().groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("_w")))
        out = links.groupBy("source_id").agg(F.sum("_w").alias("_out"))
        ids = workspace.keep(self.nodes.select("id").join(out, F.col("id") == F.col("source_id"), "left").select("id", F.col("_out")))
        n = ids.count()
        links = workspace.keep(links.join(out, "source_id").select("source_id", "target_id", (F.col("_w") / F.col("_out")).alias("_share")))
        ranks = ids.select("id", "_out", F.lit(1.0 / max(1, n)).alias("pagerank"))
        for i in range(rounds):
            dangling = ranks.agg(F.coalesce(F.sum(F.when(F.col("_out").isNull(), F.col("pagerank"))), F.lit(0.0)).alias("_d"))
            got = links.join(ranks.select(F.col("id").alias("source_id"), "pagerank"), "source_id").groupBy(F.col("target_id").alias("id")).agg(F.sum(F.col("_share") * F.col("pagerank")).alias("_in"))
            step = ranks.select("id", "_out").join(got, "id", "left").crossJoin(F.broadcast(dangling))  # one row
            ranks = step.select("id", "_out", (F.lit((1 - damping) / n) + damping * (F.coalesce("_in", F.lit(0.0)) + F.col("_d") / n)).alias("pagerank"))
            ranks = workspace.keep(ranks)
        return ranks.select("id", "pagerank")

    def resolve_external(self, external: DataFrame) -> DataFrame:
        """(external_id, id): references of the form ``...:name`` to the nodes of that name."""
        named = external.select("external_id", F.element_at(F.split("external_id", ":"), -1).alias("name"))
        return named.join(self.nodes.select("name", "id"), "name").groupBy("external_id").agg(F.max("id").alias("id"))


def write_subgraph(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with the new ones: a node of a known id is replaced, an edge that is there or dangles is ignored."""
    w = Window.partitionBy("id").orderBy(F.desc("_new"))
    every = nodes.withColumn("_new", F.lit(0)).unionByName(new_nodes.select(nodes.columns).withColumn("_new", F.lit(1)))
    out = every.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_new")
    ids = out.select("id")
    fresh = new_edges.select(edges.columns).dropDuplicates(["source_id", "target_id", "type"]).join(edges, ["source_id", "target_id", "type"], "left_anti")
    fresh = fresh.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return out, edges.unionByName(fresh.select(edges.columns))


def node_id(file_path: str, name: str, line: str, source: str | None = None) -> Column:
    """``file:name:line``, with 16 places of the source's SHA-256 where ``source`` is a column."""
    parts = [F.col(file_path), F.col(name), F.col(line).cast("string")]
    return F.concat_ws(":", *parts, *([F.left(F.sha2(source, 256), F.lit(16))] if source else []))


def edge_id(source: str, target: str, kind: str) -> Column:
    return F.concat(F.col(source), F.lit("->"), F.col(target), F.lit(":"), F.col(kind))
