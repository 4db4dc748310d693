"""Structured Streaming forms: event-time windows, deduplication, stored-query matching and expiring state.

Every stateful operator is bounded by a watermark. The same functions run on static DataFrames, which the tests use to hold
streams against batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from velumine.operators.state import match_triggers


def _marked(df: DataFrame, ts: str, late: str) -> DataFrame:
    return df.withWatermark(ts, late) if df.isStreaming else df


def tumbling(df: DataFrame, ts: str = "ts", width: str = "1 hour", by: str = "event_type", value: str = "value", late: str = "1 hour") -> DataFrame:
    """(window_start, by, n, total) of each window. ``ts`` is a timestamp."""
    out = _marked(df, ts, late).groupBy(F.window(ts, width).alias("_w"), by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"))
    return out.select(F.col("_w.start").alias("window_start"), by, "n", "total")


def sliding(df: DataFrame, ts: str = "ts", width: str = "1 hour", slide: str = "30 minutes", by: str = "event_type", late: str = "1 hour") -> DataFrame:
    out = _marked(df, ts, late).groupBy(F.window(ts, width, slide).alias("_w"), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("_w.start").alias("window_start"), by, "n")


def sessions(df: DataFrame, ts: str = "ts", gap: str = "30 minutes", by: str = "user_id", late: str = "1 hour") -> DataFrame:
    """(by, session_start, session_end, n) of runs of events no more than ``gap`` apart."""
    out = _marked(df, ts, late).groupBy(F.session_window(ts, gap).alias("_w"), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(by, F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), "n")


def deduplicate(df: DataFrame, key: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if df.isStreaming else df.dropDuplicates([key])


def percolate(documents: DataFrame, triggers: DataFrame) -> DataFrame:
    """Stored queries matched as documents arrive: a stream-static join."""
    return match_triggers(documents, triggers)


_STATE = "last_value double, updates long"


def _latest(keys: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState, ttl_ms: int) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        value, n = state.get
        state.remove()
        yield pd.DataFrame({"key": [str(keys[0])], "value": [value], "updates": [n], "expired": [True]})
        return
    value, n = state.get if state.exists else (None, 0)
    at = None
    for b in batches:
        b = b.sort_values("ts", kind="stable")
        value, n, at = float(b["value"].iloc[-1]), n + len(b), b["ts"].iloc[-1]
    state.update((value, n))
    now = state.getCurrentWatermarkMs()
    state.setTimeoutTimestamp(max(now + 1, int(at.timestamp() * 1000) + ttl_ms if at is not None else now + ttl_ms))
    yield pd.DataFrame({"key": [str(keys[0])], "value": [value], "updates": [n], "expired": [False]})


def expiring_cache(df: DataFrame, key: str, ts: str = "ts", value: str = "value", ttl_ms: int = 3_600_000, late: str = "10 minutes") -> DataFrame:
    """(key, value, updates, expired): the latest value of each key; a key silent for ``ttl_ms`` of event time expires."""
    rows = df.withWatermark(ts, late).select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"), F.col(value).cast("double").alias("value"))
    run: Callable = lambda k, b, s: _latest(k, b, s, ttl_ms)
    return rows.groupBy("key").applyInPandasWithState(run, "key string, value double, updates long, expired boolean", _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def scheduled(df: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Calls ``action`` with each micro-batch of new rows and its number, every so often or, without ``every``, until what is
    there has been read: a refresh of centroids, or of ranks, whenever rows have arrived."""
    writer = df.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def refresh_centroids(df: DataFrame, by: str, path: str, checkpoint: str, vector: str = "embedding", every: str | None = None) -> StreamingQuery:
    """Keeps the sums and counts of each group in ``path`` up to date as vectors arrive, one folder per micro-batch, so that a
    batch that runs again replaces itself; ``centroids_of`` reads them."""
    from velumine.operators.search import centroids

    def action(batch: DataFrame, number: int) -> None:
        centroids(batch, by, vector).drop("centroid_norm").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return scheduled(df, action, checkpoint, every)


def centroids_of(spark: SparkSession, path: str, by: str) -> DataFrame:
    """(by, centroid, n) of all batches so far."""
    rows = spark.read.parquet(path).select(by, "n", F.posexplode("centroid").alias("pos", "x"))
    means = rows.groupBy(by, "pos").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("m"), F.sum("n").alias("n"))
    out = means.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("_p"), F.max("n").alias("n"))  # one vector
    return out.select(by, F.transform("_p", lambda p: p["m"]).alias("centroid"), "n")


def refresh_pagerank(edges: DataFrame, make: Callable[[], DataFrame], path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Writes ``make()``, the ranks of the whole graph, anew whenever edges have arrived."""

    def action(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            make().write.mode("overwrite").parquet(f"{path}/batch={number}")

    return scheduled(edges, action, checkpoint, every)


def upsert_sink(df: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """Writes each micro-batch under its number, so that a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
