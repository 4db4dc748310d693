"""Agent memory over two tables: memories and the relations among them. Operations return new DataFrames to be written."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velumine.functions import vector as V
from velumine.functions.text import key

#: Types of memories.
TYPES = ("episodic", "semantic", "procedural", "working")


def clean(memories: DataFrame) -> DataFrame:
    """Memories with canonical keys and types, each once."""
    cols = [c for c in memories.columns if c not in ("id", "type")]
    rows = memories.select(key("id").alias("id"), F.lower(F.btrim("type")).alias("type"), *cols).filter("id is not null")
    # Of the rows of an id the earliest counts, of equal ones the one that comes first as text.
    best = F.min_by(F.struct("type", *cols), F.struct(F.col("created_at").isNull(), "created_at", F.to_json(F.struct("type", *[c for c in cols if c != "embedding"]))))
    return rows.groupBy("id").agg(best.alias("_m")).select("id", "_m.*")


def remember(memories: DataFrame, new: DataFrame) -> DataFrame:
    """``memories`` with new rows; columns the new ones lack are null."""
    return memories.unionByName(new, allowMissingColumns=True)


def relate(edges: DataFrame, new: DataFrame) -> DataFrame:
    return edges.unionByName(new, allowMissingColumns=True)


def forget(memories: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Marks memories as forgotten; they stay in the table."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    out = memories.join(hit, "id", "left")
    return out.withColumn("forgotten_at", F.when(F.col("_hit"), F.coalesce("forgotten_at", now)).otherwise(F.col("forgotten_at"))).withColumn("forgotten", F.when(F.col("_hit"), 1).otherwise(F.col("forgotten"))).drop("_hit")


def delete(memories: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Removes memories, and relations at either end of them."""
    gone = ids.select("id").distinct()
    e = edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return memories.join(gone, "id", "left_anti"), e


def score(similarity: Column, importance: Column, access_count: Column, created_at: Column, now: Column) -> Column:
    """similarity x importance x 1 / (1 + age in hours / 168) x (1 + ln(1 + accesses) / 10)."""
    hours = F.timestamp_diff("SECOND", created_at, now) / 3600.0
    return F.round(similarity * F.coalesce(importance, F.lit(0.5)) / (1 + F.coalesce(hours, F.lit(0.0)) / 168.0) * (1 + F.ln(1 + F.coalesce(access_count, F.lit(0))) / 10.0), 4)


def recall(memories: DataFrame, query: Sequence[float], now: Column, k: int = 10, session_id: str | None = None, types: Sequence[str] | None = None, vector: str = "embedding") -> DataFrame:
    """The ``k`` best of the ``2k`` most similar memories that are not forgotten, by ``score``."""
    rows = memories.filter(F.coalesce("forgotten", F.lit(0)) == 0)
    if session_id is not None:
        rows = rows.filter(F.col("session_id") == session_id)
    if types is not None:
        rows = rows.filter(F.col("type").isin(list(types)))
    near = rows.withColumn("similarity", V.cosine(F.col(vector), V.vec(list(query)))).orderBy(F.desc("similarity"), "id").limit(2 * k)
    out = near.withColumn("score", score(F.col("similarity"), F.col("importance"), F.col("access_count"), F.col("created_at"), now))
    return out.orderBy(F.desc("score"), "id").limit(k)


def related(hits: DataFrame, edges: DataFrame, memories: DataFrame, most: int = 10) -> DataFrame:
    """(hit_id, id, type, weight): memories one relation away from each hit, the strongest ``most``."""
    from velumine.operators.relational import top_per_key

    h = hits.select(F.col("id").alias("hit_id"))
    out = edges.select(F.col("source_id").alias("hit_id"), F.col("target_id").alias("id"), "type", "weight")
    back = edges.select(F.col("target_id").alias("hit_id"), F.col("source_id").alias("id"), "type", "weight")
    near = out.unionByName(back).join(h, "hit_id", "left_semi").join(memories.select("id"), "id", "left_semi").distinct()
    return top_per_key(near, ["hit_id"], [F.desc_nulls_last("weight"), F.asc("id"), F.asc("type")], most, salt="id")


def consolidate(memories: DataFrame, now: Column, least: int = 10, older_hours: int = 24, bullets: int = 20, width: int = 200) -> DataFrame:
    """(session_id, tag, n, importance, summary): old episodic memories of each session with enough of them, by first tag.

    A summary takes the first ``bullets`` memories by time, picked in salted parts, so that a large session meets nowhere.
    """
    from velumine.operators.relational import top_per_key

    old = memories.filter((F.col("type") == "episodic") & (F.coalesce("forgotten", F.lit(0)) == 0) & (F.timestamp_diff("HOUR", F.col("created_at"), now) > older_hours))
    tag = F.coalesce(F.get("tags", F.lit(0)), F.lit("general"))
    old = old.select("id", "session_id", tag.alias("tag"), "importance", "created_at", "content")
    enough = old.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select("session_id")
    old = old.join(enough, "session_id", "left_semi")
    stats = old.groupBy("session_id", "tag").agg(F.count(F.lit(1)).alias("n"), _mean("importance").alias("importance"))
    first = top_per_key(old, ["session_id", "tag"], [F.asc("created_at"), F.asc("id")], bullets, salt="id")
    line = F.concat(F.lit("- "), F.left(F.coalesce("content", F.lit("")), F.lit(width)))
    text = first.groupBy("session_id", "tag").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id", line.alias("t")))), lambda x: x["t"]), "\n").alias("summary"))
    return stats.join(text, ["session_id", "tag"])


def _mean(col: str) -> Column:
    """Mean to three places; exact in decimals, so that ties round alike whatever the order of the rows."""
    return F.round(F.avg(F.col(col).cast("decimal(18,6)")), 3).cast("double")


def stats(memories: DataFrame) -> DataFrame:
    """(session_id, total, per type, forgotten, avg_importance)."""
    per = [F.count_if((F.col("type") == t) & (F.coalesce("forgotten", F.lit(0)) == 0)).alias(t) for t in TYPES]
    return memories.groupBy("session_id").agg(F.count(F.lit(1)).alias("total"), *per, F.count_if(F.col("forgotten") == 1).alias("forgotten"), _mean("importance").alias("avg_importance"))


def timeline(memories: DataFrame, session_id: str, most: int = 50) -> DataFrame:
    """The latest memories of a session."""
    return memories.filter(F.col("session_id") == session_id).orderBy(F.desc_nulls_last("created_at"), "id").limit(most)


def touched(memories: DataFrame, hits: DataFrame, now: Column) -> DataFrame:
    """``memories`` with the hits of a recall counted as accessed now."""
    hit = hits.select("id").distinct().withColumn("_hit", F.lit(True))
    out = memories.join(hit, "id", "left")
    count = F.coalesce("access_count", F.lit(0)) + F.when(F.col("_hit"), 1).otherwise(0)
    return out.withColumn("access_count", F.when(F.col("_hit"), count).otherwise(F.col("access_count"))).withColumn("last_accessed_at", F.when(F.col("_hit"), now).otherwise(F.col("last_accessed_at"))).drop("_hit")


def summarise_with(memories: DataFrame, part: Callable[[pd.DataFrame], dict], merge: Callable[[list[dict]], dict], schema: str, columns: Sequence[str], by: str = "session_id") -> DataFrame:
    """A custom summary, one row per group: ``part`` folds a salted part of a group's rows, ``merge`` the few parts."""
    from velumine.operators.relational import folded

    return folded(memories, [by], columns, part, merge, schema)


class Fabric:
    """Memories that agents share: nodes (id, agent_id, content, created_at) and links (source_id, target_id, type). Operations
    return a new fabric."""

    NODES = "id string, agent_id string, kind string, content string, created_at timestamp_ntz"
    LINKS = "source_id string, target_id string, type string, created_at timestamp_ntz"

    def __init__(self, nodes: DataFrame, links: DataFrame) -> None:
        self.nodes, self.links = nodes, links

    @classmethod
    def empty(cls, spark) -> Fabric:
        return cls(spark.createDataFrame([], cls.NODES), spark.createDataFrame([], cls.LINKS))

    def write(self, rows: DataFrame) -> Fabric:
        """With memories (agent_id, content, created_at, optionally kind); a memory's id is a hash of what it says and when."""
        kind = F.col("kind") if "kind" in rows.columns else F.lit("memory")
        new = rows.select(F.left(F.sha2(F.concat_ws("\u0001", "agent_id", "content", F.col("created_at").cast("string")), 256), F.lit(16)).alias("id"), "agent_id", kind.alias("kind"), "content", "created_at")
        new = new.dropDuplicates(["id"]).join(self.nodes.select("id"), "id", "left_anti")
        return Fabric(self.nodes.unionByName(new), self.links)

    def link(self, rows: DataFrame) -> Fabric:
        """With links (source_id, target_id, type, created_at) whose ends are there."""
        ids = self.nodes.select("id")
        new = rows.select("source_id", "target_id", "type", "created_at").join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
        new = new.dropDuplicates(["source_id", "target_id", "type"]).join(self.links, ["source_id", "target_id", "type"], "left_anti")
        return Fabric(self.nodes, self.links.unionByName(new.select(self.links.columns)))

    def record(self, rows: DataFrame) -> Fabric:
        """With actions (agent_id, action, target_id, created_at): memories of kind ``action``, each linked to its target."""
        acts = rows.select("agent_id", F.col("action").alias("content"), "created_at", F.lit("action").alias("kind"), "target_id")
        made = self.write(acts.drop("target_id"))
        ids = acts.join(made.nodes.filter("kind = 'action'").select("id", "agent_id", "content", "created_at"), ["agent_id", "content", "created_at"])
        return made.link(ids.select(F.col("id").alias("source_id"), "target_id", F.lit("acts_on").alias("type"), "created_at"))

    def read(self, agent_id: str, words: Sequence[str] = (), most: int = 20) -> DataFrame:
        """An agent's latest memories that hold any of ``words``."""
        cond = F.lit(not words)
        for w in words:
            cond = cond | F.col("content").ilike(f"%{w}%")
        return self.nodes.filter((F.col("agent_id") == agent_id) & cond).orderBy(F.desc("created_at"), "id").limit(most)

    def timeline(self, agent_id: str, most: int = 50) -> DataFrame:
        return self.read(agent_id, most=most)

    def context(self, agent_id: str, most: int = 10) -> DataFrame:
        """(id, content, linked): an agent's latest memories with the ids one link away, at most ten each."""
        from velumine.operators.relational import top_per_key

        own = self.read(agent_id, most=most).select("id", "content")
        out = self.links.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"))
        both = out.unionByName(self.links.select(F.col("target_id").alias("id"), F.col("source_id").alias("other"))).join(own.select("id"), "id", "left_semi").distinct()
        few = top_per_key(both, ["id"], [F.asc("other")], 10, salt="other").groupBy("id").agg(F.array_sort(F.collect_list("other")).alias("linked"))
        return own.join(few, "id", "left").select("id", "content", F.coalesce("linked", F.array().cast("array<string>")).alias("linked"))
