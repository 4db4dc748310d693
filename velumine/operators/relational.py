"""Relational building blocks that Spark has no single operator for."""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from velumine.sources.tables import load

#: Seconds of the named windows (a month has 30 days).
WINDOWS = {"hour": 3_600, "day": 86_400, "week": 604_800, "month": 2_592_000}

#: Languages by file extension.
LANGUAGES = {
    "ex": "elixir", "exs": "elixir", "heex": "elixir", "py": "python", "pyi": "python", "rs": "rust", "go": "go",
    "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript",
    "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "rb": "ruby", "sql": "sql",
    "sh": "bash", "bash": "bash", "yml": "yaml", "yaml": "yaml", "json": "json", "md": "markdown",
}


def sql(spark: SparkSession, sf_dir: str, text: str, args: Mapping[str, object] | None = None, tables: Sequence[str] = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "chunks", "nodes", "edges", "memories", "memory_edges")) -> DataFrame:
    """A SQL text over the tables of a folder, with named parameters. Views are made only of the tables it names."""
    for t in tables:
        if re.search(rf"\b{t}\b", text, re.I):
            load(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(text, args=dict(args or {}))


def lenient_json(col: str) -> Column:
    """A variant of the JSON text, null where it can't be parsed."""
    return F.try_parse_json(col)


def in_window(df: DataFrame, ts: str, now: str, window: str) -> DataFrame:
    """Rows later than ``window`` before ``now`` and not after it."""
    end = F.lit(now).cast("timestamp_ntz")
    start = end - F.expr(f"INTERVAL {WINDOWS[window]} SECONDS")
    return df.filter((F.col(ts) > start) & (F.col(ts) <= end))


def range_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, before_seconds: int) -> DataFrame:
    """Pairs of one key where the right time lies in [left - before, left).

    Times are cut into bins of the range's length: a left row meets two bins only, so a hot key's pairs are spread over its
    bins and nothing outside the range is paired.
    """
    width = before_seconds * 1_000_000
    micros = lambda c: F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(`{c}` as timestamp_ntz))")
    lo = F.floor(micros(left_ts) / width).cast("long")
    a = left.withColumn("_l", micros(left_ts)).withColumn("_bin", F.explode(F.array(lo - 1, lo)))
    b = right.withColumn("_r", micros(right_ts)).withColumn("_bin", F.floor(micros(right_ts) / width).cast("long"))
    return a.join(b, [key, "_bin"]).filter((F.col("_r") >= F.col("_l") - width) & (F.col("_r") < F.col("_l"))).drop("_bin", "_l", "_r")


def asof_join(left: DataFrame, right: DataFrame, key: str, ts: str, values: Sequence[str], bin_seconds: int = 86_400) -> DataFrame:
    """``left`` with the values of the last right row of its key at or before its time, nulls included; no pairs are made.

    Both sides are one union, read in order within bins of time, so that a hot key is spread over its bins; what a bin has
    not seen itself comes from the last right row of the bins before, one row per key and bin. Of right rows at one time the
    greatest values count.
    """
    have = [c for c in left.columns if c not in (key, ts)]
    row = F.struct(*values)
    micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(`{ts}` as timestamp_ntz))")
    a = left.select(key, ts, F.struct(*[F.col(c) for c in have]).alias("_row"), F.lit(1).alias("_side"))
    b = right.select(key, ts, row.alias("_value"), F.lit(0).alias("_side"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_bin", F.floor(micros / (bin_seconds * 1_000_000)).cast("long"))
    w = Window.partitionBy(key, "_bin").orderBy(ts, "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_seen", F.last("_value", ignorenulls=True).over(w)).filter("_side = 1")
    bins = both.groupBy(key, "_bin").agg(F.max_by("_value", F.when(F.col("_side") == 0, F.struct(ts, "_value"))).alias("_last"))
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    carried = bins.select(key, "_bin", before.alias("_before"))
    out = seen.join(carried, [key, "_bin"]).withColumn("_v", F.coalesce("_seen", "_before"))
    return out.select(key, ts, *[F.col(f"_row.{c}").alias(c) for c in have], *[F.col(f"_v.{v}").alias(v) for v in values])


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by an aggregate with map-side combining, so that a hot key meets nowhere as a group."""
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, salt: str, parts: int = 32) -> DataFrame:
    """The first ``k`` rows of each key; keys are salted first, so only ``k`` rows of each part meet."""
    part = df.withColumn("_p", F.pmod(F.xxhash64(salt), F.lit(parts)))
    few = part.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_p").orderBy(*order))).filter(F.col("_r") <= k)
    return few.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= k).drop("_r", "_p")


def nearest_rank(df: DataFrame, by: str, value: str, ranks: Mapping[str, float]) -> DataFrame:
    """Nearest-rank percentiles: the value at place round(p * (n - 1)) of the sorted values, nulls left out.

    Values are counted first; cumulative counts then find the places, so no list of a group is built.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(by).orderBy(value)
    placed = counts.withColumn("_end", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(by)))
    out = []
    for name, p in ranks.items():
        place = F.round(F.lit(p) * (F.col("_all") - 1))
        out.append(F.min(F.when(F.col("_end") > place, F.col(value))).alias(name))
    return placed.groupBy(by).agg(*out)


def video_id(url: Column) -> Column:
    """The eleven places of a video's id in its address (watch?v=, a short link, embed, shorts), or null."""
    return F.nullif(F.regexp_extract(url, r"(?:[?&]v=|youtu\.be/|/embed/|/shorts/)([A-Za-z0-9_-]{11})(?![A-Za-z0-9_-])", 1), F.lit(""))


def urls(text: Column) -> Column:
    """The addresses in a text, each once, in their order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(https?://[^\s<>()\[\]{}\"'`|\\^]+)"), F.lit(1)))


def folded(df: DataFrame, by: Sequence[str], columns: Sequence[str], part: Callable[[pd.DataFrame], dict], merge: Callable[[list[dict]], dict], schema: str, salt: int = 16) -> DataFrame:
    """A custom aggregate: ``part`` folds the rows of a salted part of each group to a dictionary, ``merge`` the few of a group
    to the row of ``schema`` (behind the columns of ``by``), so that no task holds a hot group."""
    keys, cols = list(by), list(columns)
    salted = df.select(*keys, *cols, F.pmod(F.xxhash64(*cols), F.lit(salt)).cast("int").alias("_part"))
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def first(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key[:-1], pickle.dumps(part(rows[cols]))]], columns=[*keys, "_state"])

    def second(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{**dict(zip(keys, key)), **merge([pickle.loads(x) for x in rows["_state"]])}])

    partial = salted.groupBy(*keys, "_part").applyInPandas(first, f"{kinds}, _state binary")
    return partial.groupBy(*keys).applyInPandas(second, f"{kinds}, {schema}")


def geometric_mean(col: str) -> Column:
    """An aggregate composed of others: exp of the mean logarithm."""
    return F.exp(F.avg(F.ln(col)))


def merge_hits(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of ``first`` (source_rank 0) and those of ``second`` that it lacks (1)."""
    return first.withColumn("source_rank", F.lit(0)).unionByName(second.join(first.select(key), key, "left_anti").withColumn("source_rank", F.lit(1)))


def first_segment(path: str) -> Column:
    """Text before the first slash; empty without one or with a leading one."""
    at = F.instr(path, "/")
    return F.when(at > 1, F.left(F.col(path), at - 1)).otherwise(F.lit(""))


def package(path: str) -> Column:
    """The first segment that isn't empty, or ``_root``."""
    return F.coalesce(F.get(F.filter(F.split(path, "/"), lambda x: x != F.lit("")), F.lit(0)), F.lit("_root"))


def language_of(path: str) -> Column:
    """Language by file extension, or ``unknown``."""
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, F.lower(F.regexp_extract(F.trim(path), r"\.([A-Za-z]+)$", 1))), F.lit("unknown"))


def token_estimate(text: str) -> Column:
    """Characters divided by four."""
    return F.floor(F.length(text) / 4).cast("long")


def slug(text: Column, most: int = 40) -> Column:
    return F.left(F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_")), F.lit(most))


def interpolate(template: str, values: Mapping[str, Column]) -> Column:
    """``template`` with ``{{name}}`` replaced; unknown names are left as they are."""
    parts, at = [], 0
    for m in re.finditer(r"\{\{\s*(\w+)\s*\}\}", template):
        if m.group(1) in values:
            parts += [F.lit(template[at : m.start()]), F.coalesce(values[m.group(1)].cast("string"), F.lit(""))]
            at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def line_diff(a: Column, b: Column) -> Column:
    """(added, removed): lines that differ place by place, each counted on either side."""
    x, y = F.split(a, "\n"), F.split(b, "\n")
    changed = F.size(F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda z: ~z["x"].eqNullSafe(z["y"]) & z["x"].isNotNull() & z["y"].isNotNull()))
    more, fewer = F.greatest(F.size(y) - F.size(x), F.lit(0)), F.greatest(F.size(x) - F.size(y), F.lit(0))
    return F.struct((changed + more).alias("added"), (changed + fewer).alias("removed"))


def enclosing(sites: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, span_id: str, site_id: str, width: int = 64) -> DataFrame:
    """(site_id, enclosing): the shortest span of the same key that holds each site, ties by id. Both sides meet in bins of
    ``width``, so that a key with many spans isn't paired as a whole."""
    a = sites.withColumn("_bin", F.floor(F.col(at) / width).cast("long"))
    b = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width).cast("long"), F.greatest(F.floor(F.col(start) / width), F.floor(F.col(end) / width)).cast("long"))))
    both = a.join(b, [key, "_bin"]).filter((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end)))
    return both.groupBy(site_id).agg(F.min_by(span_id, F.struct((F.col(end) - F.col(start)).alias("_w"), F.col(span_id).alias("_i"))).alias("enclosing"))
