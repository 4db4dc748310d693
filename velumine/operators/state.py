"""Handles, semantic cache, stored-query triggers, prompts, pipelines and tenants as small tables and transforms."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from abc import ABC, abstractmethod
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from velumine.functions import vector as V
from velumine.operators.relational import interpolate, line_diff, package
from velumine.session import Workspace, checkpoint_root
from velumine.sources.readers import Storage


def _equals(word: str) -> Callable[[Column], Column]:
    return lambda x: x == F.lit(word)


class Handles:
    """Named results: stored as Parquet, shown as a short stub, read page by page. The registry is a table beside them, so it
    outlives the session; the oldest are evicted beyond ``most``, with their files. Expired ones are not found any more."""

    SCHEMA = "name string, path string, n long, preview string, ttl_seconds long, created_at timestamp_ntz"

    def __init__(self, spark: SparkSession, root: str | None = None, most: int = 1000) -> None:
        self.spark, self.root, self.most = spark, root or f"{checkpoint_root(spark)}/handles-{uuid.uuid4().hex[:8]}", most
        self._storage = Storage(spark, self.root)

    def registry(self, now: datetime | None = None) -> DataFrame:
        """(name, path, n, preview, ttl_seconds, created_at) of the handles that have not expired."""
        files = [f for f in self._storage.list("registry") if not f.startswith("_")]
        if not files:
            return self.spark.createDataFrame([], self.SCHEMA)
        df = self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.root}/registry/{f}" for f in files])
        at = F.lit(now or datetime.now()).cast("timestamp_ntz")
        return df.filter(F.timestamp_diff("SECOND", F.col("created_at"), at) <= F.col("ttl_seconds"))

    def store(self, name: str, df: DataFrame, order: Sequence[str], ttl_seconds: int = 3600, created_at: datetime | None = None) -> str:
        """Writes ``df`` numbered by ``order`` and returns its stub."""
        self.delete(name)
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        ranged = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
        ranged.withColumn("_place", F.monotonically_increasing_id()).write.parquet(path)
        kept = self.spark.read.parquet(path)
        n = kept.count()
        first = [tuple(r) for r in kept.orderBy("_place").limit(3).drop("_place").collect()]
        preview = f"{name}: Array({n}) {first}"
        preview = preview if len(preview) <= 120 else preview[:117] + "..."
        row = self.spark.createDataFrame([(name, path, n, preview, ttl_seconds, created_at or datetime.now())], self.SCHEMA)
        row.coalesce(1).write.parquet(f"{self.root}/registry/{uuid.uuid4().hex}")
        known = self.registry().orderBy("created_at", "name").select("name").collect()  # at most ``most`` + 1 names
        for r in known[: max(0, len(known) - self.most)]:
            self.delete(r["name"])
        return preview

    def _one(self, name: str) -> dict:
        row = self.registry().filter(F.col("name") == name).orderBy(F.desc("created_at")).first()
        if row is None:
            raise KeyError(name)
        return row.asDict()

    def expand(self, name: str, offset: int = 0, limit: int = 10) -> DataFrame:
        """A page; places rise with the order stored, so a page is a top-k and no global sort."""
        return self.spark.read.parquet(self._one(name)["path"]).orderBy("_place").offset(offset).limit(limit).drop("_place")

    def count(self, name: str) -> int:
        return self._one(name)["n"]

    def names(self) -> list[str]:
        return sorted(r["name"] for r in self.registry().select("name").collect())

    def delete(self, name: str) -> bool:
        """Removes a handle, expired or not, with its files."""
        gone = False
        for f in [f for f in self._storage.list("registry") if not f.startswith("_")]:
            row = self.spark.read.schema(self.SCHEMA).parquet(f"{self.root}/registry/{f}").first()
            if row is not None and row["name"] == name:
                self._storage.delete(f"registry/{f}")
                gone = self._storage.delete(row["path"][len(self.root) + 1 :]) or gone
        return gone

    def search(self, text: str, limit: int = 20, now: datetime | None = None) -> DataFrame:
        """(name, n, preview, rank): handles whose name and preview hold all words of ``text``, most occurrences first; where
        none does, those that hold it as it stands, the latest first."""
        rows = self.registry(now).withColumn("_all", F.lower(F.concat_ws(" ", "name", "preview")))
        words = F.filter(F.split("_all", r"\W+"), lambda w: w != "")
        asked = [w for w in re.split(r"\W+", text.lower()) if w]
        hits = F.lit(0)
        every = F.lit(bool(asked))
        for w in asked:
            n = F.size(F.filter(words, _equals(w)))
            hits, every = hits + n, every & (n > 0)
        found = rows.filter(every).select("name", "n", "preview", hits.cast("long").alias("_rank"), "created_at").orderBy(F.desc("_rank"), "name").limit(limit)
        if found.isEmpty():
            found = rows.filter(F.contains("_all", F.lit(text.lower()))).select("name", "n", "preview", F.lit(0).cast("long").alias("_rank"), "created_at").orderBy(F.desc("created_at"), "name").limit(limit)
        return found.select("name", "n", "preview", F.col("_rank").alias("rank"))


class Cache(ABC):
    """What a cache of results must do: get by key until expiry, put with a time to live, drop."""

    @abstractmethod
    def get(self, key: str, now: datetime | None = None): ...

    @abstractmethod
    def put(self, key: str, value, ttl_seconds: int | None = None, now: datetime | None = None) -> None: ...

    @abstractmethod
    def delete(self, key: str) -> bool: ...


class LruCache(Cache):
    """Small values in memory; the least recently used goes beyond ``most``."""

    def __init__(self, most: int = 10_000) -> None:
        self.most, self._held = most, OrderedDict()
        self.hits = self.misses = 0

    def get(self, key: str, now: datetime | None = None):
        entry = self._held.get(key)
        if entry is None or entry[1] is not None and entry[1] <= (now or datetime.now()):
            self._held.pop(key, None)
            self.misses += 1
            return None
        self._held.move_to_end(key)
        self.hits += 1
        return entry[0]

    def put(self, key: str, value, ttl_seconds: int | None = None, now: datetime | None = None) -> None:
        self._held.pop(key, None)
        while len(self._held) >= self.most:
            self._held.popitem(last=False)
        self._held[key] = (value, None if ttl_seconds is None else (now or datetime.now()) + timedelta(seconds=ttl_seconds))

    def delete(self, key: str) -> bool:
        return self._held.pop(key, None) is not None


def cache_key(query: str, **options: object) -> str:
    """A key of the query and of every option that changes its result."""
    return hashlib.sha256(json.dumps([query, sorted(options.items())], default=str).encode()).hexdigest()


class ResultCache:
    """Results of queries as tables: written once per key, read again until they expire."""

    def __init__(self, spark: SparkSession, root: str | None = None, cache: Cache | None = None) -> None:
        self.spark, self.root, self.cache = spark, root or f"{checkpoint_root(spark)}/results-{uuid.uuid4().hex[:8]}", cache or LruCache()

    def through(self, query: str, make: Callable[[], DataFrame], ttl_seconds: int = 3600, now: datetime | None = None, **options: object) -> DataFrame:
        key = cache_key(query, **options)
        path = self.cache.get(key, now)
        if path is None:
            path = f"{self.root}/{uuid.uuid4().hex}"
            make().write.parquet(path)
            self.cache.put(key, path, ttl_seconds, now)
        return self.spark.read.parquet(path)


class EmbeddingCache:
    """Vectors of texts by the SHA-256 of the text: only texts that are not known are given to the model."""

    def __init__(self, function: Callable[[Sequence[str]], Sequence[Sequence[float]]], cache: Cache | None = None) -> None:
        self.function, self.cache = function, cache or LruCache()

    def __call__(self, texts: Sequence[str | None]) -> list[list[float]]:
        keys = [hashlib.sha256((t or "").encode("utf-8", "surrogatepass")).hexdigest() for t in texts]
        known = {k: self.cache.get(k) for k in dict.fromkeys(keys)}
        new = {k: t or "" for k, t in zip(keys, texts) if known[k] is None}
        for k, v in zip(new, self.function(list(new.values())) if new else []):
            known[k] = list(v)
            self.cache.put(k, known[k])
        return [known[k] for k in keys]


def cache_lookup(cache: DataFrame, query: Sequence[float], now: Column, threshold: float = 0.92) -> DataFrame:
    """The most similar unexpired entry of at least ``threshold``, or none."""
    rows = cache.filter(F.col("expires_at") > now).withColumn("similarity", V.cosine(F.col("embedding"), V.vec(list(query))))
    return rows.filter(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), "cache_key").limit(1)


def cache_entry(df: DataFrame, query: str, now: Column, ttl_seconds: int = 3600) -> DataFrame:
    """Entries with a key of the query, what changes its result, and a time of expiry."""
    return df.withColumn("cache_key", F.sha2(F.col(query), 256)).withColumn("created_at", now).withColumn("expires_at", now + F.expr(f"INTERVAL {ttl_seconds} SECONDS"))


def cache_purge(cache: DataFrame, now: Column) -> DataFrame:
    return cache.filter(F.col("expires_at") > now)


def cache_evict(cache: DataFrame, most: int) -> DataFrame:
    """The ``most`` latest entries."""
    return cache.orderBy(F.desc("created_at"), "cache_key").limit(most)


def cache_stats(cache: DataFrame, now: Column) -> DataFrame:
    return cache.agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("expires_at") > now).alias("active"))


def match_triggers(documents: DataFrame, triggers: DataFrame, bound: int = 10_000) -> DataFrame:
    """(trigger_id, doc_id, similarity) where a document is close enough to an active stored query.

    ``triggers`` (trigger_id, query_vector, threshold, active) is a stated set, checked to be at most ``bound`` rows and
    broadcast; works on static and streaming documents alike.
    """
    active = triggers.filter(F.coalesce("active", F.lit(True)))
    if active.limit(bound + 1).count() > bound:
        raise ValueError(f"more than {bound} active triggers")
    pairs = documents.crossJoin(F.broadcast(active))
    scored = pairs.withColumn("similarity", V.cosine(F.col("embedding"), F.col("query_vector")))
    return scored.filter(F.col("similarity") >= F.col("threshold")).select("trigger_id", "doc_id", "similarity")


class Triggers:
    """Stored queries in a DataFrame; operations return a new set."""

    SCHEMA = "trigger_id string, name string, query_vector array<double>, threshold double, target string, active boolean, created_at timestamp_ntz, last_fired_at timestamp_ntz, fire_count long"

    def __init__(self, df: DataFrame) -> None:
        self.df = df

    @classmethod
    def empty(cls, spark: SparkSession) -> Triggers:
        return cls(spark.createDataFrame([], cls.SCHEMA))

    def create(self, name: str, query_vector: Sequence[float], target: str, threshold: float = 0.8, active: bool = True, created_at: datetime | None = None, trigger_id: str | None = None) -> Triggers:
        row = (trigger_id or uuid.uuid4().hex, name, [float(x) for x in query_vector], threshold, target, active, created_at or datetime.now(), None, 0)
        return Triggers(self.df.unionByName(self.df.sparkSession.createDataFrame([row], self.SCHEMA)))

    def enable(self, trigger_id: str, active: bool = True) -> Triggers:
        return Triggers(self.df.withColumn("active", F.when(F.col("trigger_id") == trigger_id, active).otherwise(F.col("active"))))

    def delete(self, trigger_id: str) -> Triggers:
        return Triggers(self.df.filter(F.col("trigger_id") != trigger_id))

    def active(self) -> DataFrame:
        return self.df.filter("active").orderBy("created_at", "trigger_id")

    def fired(self, matches: DataFrame, now: Column) -> Triggers:
        """With the counts and times of the triggers that matched, once each."""
        hit = matches.select("trigger_id").distinct().withColumn("_hit", F.lit(True))
        out = self.df.join(hit, "trigger_id", "left")
        out = out.withColumn("fire_count", F.col("fire_count") + F.when(F.col("_hit"), 1).otherwise(0)).withColumn("last_fired_at", F.when(F.col("_hit"), now).otherwise(F.col("last_fired_at")))
        return Triggers(out.drop("_hit"))


def deliver(matches: DataFrame, send: Callable[[dict], bool], tries: int = 3) -> DataFrame:
    """(trigger_id, target, documents, delivered, attempts): each trigger's matches handed to ``send`` by the tasks, again where
    it fails or says no. Document ids travel in parts of at most 1,000."""
    w = Window.partitionBy("trigger_id").orderBy("doc_id")
    parts = matches.withColumn("_part", F.floor((F.row_number().over(w) - 1) / 1000))
    grouped = parts.groupBy("trigger_id", "target", "_part").agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                done, n = False, 0
                while not done and n < tries:
                    n += 1
                    try:
                        done = bool(send({"trigger_id": r["trigger_id"], "target": r["target"], "doc_ids": list(r["doc_ids"])}))
                    except Exception:  # noqa: BLE001  whatever the receiver raises counts as a failure
                        done = False
                rows.append((r["trigger_id"], r["target"], len(r["doc_ids"]), done, n))
            yield pd.DataFrame(rows, columns=["trigger_id", "target", "documents", "delivered", "attempts"])

    return grouped.mapInPandas(run, "trigger_id string, target string, documents long, delivered boolean, attempts int")


class Prompts:
    """Versioned templates in a DataFrame (name, version, template, is_active)."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df

    def store(self, name: str, template: str) -> Prompts:
        """With a new active version of ``name``."""
        last = self.df.filter(F.col("name") == name).agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first()["v"]
        new = self.df.sparkSession.createDataFrame([(name, last + 1, template, True)], "name string, version int, template string, is_active boolean")
        old = self.df.withColumn("is_active", F.when(F.col("name") == name, False).otherwise(F.col("is_active")))
        return Prompts(old.unionByName(new))

    def rollback(self, name: str, version: int) -> Prompts:
        return Prompts(self.df.withColumn("is_active", F.when(F.col("name") == name, F.col("version") == version).otherwise(F.col("is_active"))))

    def active(self) -> DataFrame:
        """The active version of each name, else its latest, with the number of versions."""
        best = F.max_by(F.struct("version", "template"), F.struct(F.col("is_active"), F.col("version")))
        return self.df.groupBy("name").agg(best.alias("_b"), F.max("version").alias("latest"), F.count(F.lit(1)).alias("versions")).select("name", "_b.version", "_b.template", "latest", "versions")

    def render(self, name: str, /, **values: object) -> str:
        row = self.active().filter(F.col("name") == name).first()
        if row is None:
            raise KeyError(name)
        one = self.df.sparkSession.range(1)
        return one.select(interpolate(row["template"], {k: F.lit(str(v)) for k, v in values.items()}).alias("t")).first()["t"]

    def compare(self, name: str, a: int, b: int) -> DataFrame:
        x = self.df.filter((F.col("name") == name) & (F.col("version") == a)).select("name", F.col("template").alias("a"))
        y = self.df.filter((F.col("name") == name) & (F.col("version") == b)).select("name", F.col("template").alias("b"))
        return x.join(y, "name").select("name", line_diff(F.col("a"), F.col("b")).alias("diff")).select("name", "diff.*")

    def delete(self, name: str) -> Prompts:
        return Prompts(self.df.filter(F.col("name") != name))


Step = Callable[[DataFrame], DataFrame]


@dataclass
class Pipeline:
    """A named list of (step, options), each a transform of a DataFrame of results (id, similarity, ...). ``steps`` are
    validated when it is made; a dry run returns the plan and touches no data."""

    name: str
    steps: list[tuple[str, dict]]
    version: int = 1
    registry: dict[str, Callable[..., Step]] = field(default_factory=lambda: dict(STEPS))

    def __post_init__(self) -> None:
        for kind, _ in self.steps:
            if kind not in self.registry:
                raise ValueError(f"unknown step {kind!r}")

    def redefine(self, steps: list[tuple[str, dict]]) -> Pipeline:
        return Pipeline(self.name, steps, self.version + 1, self.registry)

    def describe(self, spark: SparkSession) -> DataFrame:
        """(place, step, options): what a run would do, without a plan or data."""
        rows = [(i, kind, ", ".join(sorted(options))) for i, (kind, options) in enumerate(self.steps)]
        return spark.createDataFrame(rows, "place int, step string, options string")

    def run(self, df: DataFrame, dry: bool = False) -> DataFrame:
        if dry:
            return self.describe(df.sparkSession)
        for kind, options in self.steps:
            df = df.transform(self.registry[kind](**options))
        return df

    def recorded(self, df: DataFrame, history: DataFrame, workspace: Workspace, now: Column) -> tuple[DataFrame, DataFrame]:
        """(result, history with this run): (name, version, steps, rows, at) of every run."""
        out = workspace.keep(self.run(df))
        one = out.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(self.name).alias("name"), F.lit(self.version).alias("version"), F.lit(len(self.steps)).alias("steps"), "rows", now.alias("at"))
        return out, history.unionByName(one)


HISTORY = "name string, version int, steps int, rows long, at timestamp_ntz"


def _filter(min_relevance: float = 0.5, type: str | None = None, limit: int | None = None) -> Step:
    def run(df: DataFrame) -> DataFrame:
        out = df.filter(F.col("similarity") >= min_relevance)
        out = out if type is None else out.filter(F.col("type") == type)
        return out if limit is None else out.orderBy(F.desc("similarity"), "id").limit(limit)

    return run


def _rank(vector: float = 0.6, freshness: float = 0.2, importance: float = 0.2) -> Step:
    return lambda df: df.withColumn("score", vector * F.col("similarity") + F.lit(freshness * 0.2) + importance * F.coalesce("importance", F.lit(0.5)))


def _sort(by: str = "score", order: str = "desc") -> Step:
    return lambda df: df.orderBy(F.desc(by) if order == "desc" else F.asc(by), "id")


def _limit(count: int = 10, by: str = "score") -> Step:
    return lambda df: df.orderBy(F.desc(by), "id").limit(count)


def _summarise(text: str = "text", most: int = 10) -> Step:
    def run(df: DataFrame) -> DataFrame:
        few = df.orderBy(F.desc("similarity"), "id").limit(most)
        return few.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("_s"), "id", F.col(text).alias("t")))), lambda x: F.concat(F.lit("- "), x["t"])), "\n").alias("summary"))

    return run


STEPS: dict[str, Callable[..., Step]] = {
    "search": lambda query, vector="embedding": lambda df: df.withColumn("similarity", V.cosine(F.col(vector), V.vec(list(query)))),
    "filter": _filter,
    "rank": _rank,
    "sort": _sort,
    "limit": _limit,
    "deduplicate": lambda by="id": lambda df: df.dropDuplicates([by]),
    "merge": lambda other: lambda df: df.unionByName(other, allowMissingColumns=True),
    "expand": lambda edges: lambda df: df.join(edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("related_id")), "id", "left"),
    "traverse": lambda edges, relation: lambda df: df.join(edges.filter(F.col("type") == relation).select(F.col("source_id").alias("id"), F.col("target_id").alias("related_id")), "id"),
    "summarise": _summarise,
    "webhook": lambda send: lambda df: df.transform(send),
}


def placed(nodes: DataFrame, path: str = "file_path", id_col: str = "id", shards: int = 64, most: int = 50_000) -> DataFrame:
    """(id, package, shard, overflow): a package's nodes share a shard; beyond ``most`` nodes of one shard the next ones go to
    its overflow shards 1, 2, ... in order of a hash. Nodes are counted and numbered in parts of a shard, never as a whole."""
    rows = nodes.select(F.col(id_col), package(path).alias("package"), shard_of(path, shards).alias("shard"), F.pmod(F.xxhash64(id_col), F.lit(256)).cast("int").alias("_p"))
    counts = rows.groupBy("shard", "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "_p", before.alias("_start"))
    nth = F.row_number().over(Window.partitionBy("shard", "_p").orderBy(id_col)) - 1
    return rows.withColumn("_k", nth).join(starts, ["shard", "_p"]).select(id_col, "package", "shard", F.floor((F.col("_start") + F.col("_k")) / most).cast("int").alias("overflow"))


def shard_of(path: str, shards: int = 64) -> Column:
    """The shard of a file: its package hashed."""
    return F.pmod(F.pmod(F.xxhash64(package(path)), F.lit(256)), F.lit(shards)).cast("int")


def quota_used(usage: DataFrame, quotas: DataFrame) -> DataFrame:
    """(tenant, bytes, quota_bytes, exceeded): usage summed before the join."""
    used = usage.groupBy("tenant").agg(F.sum("bytes").alias("bytes"))
    return quotas.join(used, "tenant", "left").select("tenant", F.coalesce("bytes", F.lit(0)).alias("bytes"), "quota_bytes", (F.coalesce("bytes", F.lit(0)) > F.col("quota_bytes")).alias("exceeded"))


def tenant_path(root: str, tenant: str) -> str:
    """The folder of a tenant; a tenant's name can't leave it."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]*", tenant):
        raise ValueError(f"not a tenant: {tenant!r}")
    return f"{root.rstrip('/')}/tenants/{tenant}"


def usage_log(usage: DataFrame, day: str = "at") -> DataFrame:
    """(tenant, day, operations, bytes) of a log of operations."""
    return usage.groupBy("tenant", F.to_date(day).alias("day")).agg(F.count(F.lit(1)).alias("operations"), F.sum("bytes").alias("bytes"))
