"""Retrieval quality: per-query metrics as column expressions, reports and thresholds over events."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from velumine.operators.relational import nearest_rank

#: Fixed schema of evaluation events.
SCHEMA = "event_type string, query string, retrieved_ids array<string>, expected_ids array<string>, relevance_scores array<double>, latency_ms double, session_id string, created_at timestamp_ntz"


def track(events: DataFrame, new: DataFrame) -> DataFrame:
    """``events`` with new ones; columns that those lack are null, others are left out."""
    fields = StructType.fromDDL(SCHEMA).fields
    cols = [(F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    return events.unionByName(new.select(*cols))


def tracked(events: DataFrame, event_type: str | None = None, session_id: str | None = None, most: int = 100) -> DataFrame:
    """The latest events of a type and session."""
    rows = events if event_type is None else events.filter(F.col("event_type") == event_type)
    rows = rows if session_id is None else rows.filter(F.col("session_id") == session_id)
    return rows.orderBy(F.desc("created_at"), "query").limit(most)


def _hits(retrieved: Column, expected: Column) -> Column:
    return F.size(F.filter(retrieved, lambda x: F.array_contains(expected, x)))


def precision_at(retrieved: Column, expected: Column, k: int) -> Column:
    """Hits among the first ``k`` by min(k, retrieved); 1 where nothing was retrieved."""
    n = F.least(F.lit(k), F.size(retrieved))
    return F.when(F.size(retrieved) == 0, F.lit(1.0)).otherwise(F.round(F.try_divide(_hits(F.slice(retrieved, 1, k), expected).cast("double"), n), 4))


def recall_at(retrieved: Column, expected: Column, k: int, count: Column | None = None) -> Column:
    """Hits among the first ``k`` by the expected; 1 where nothing was expected. ``count`` is how many were expected where
    ``expected`` names only those of them that were retrieved."""
    n = F.size(expected) if count is None else count
    return F.when(n == 0, F.lit(1.0)).otherwise(F.round(F.try_divide(_hits(F.slice(retrieved, 1, k), expected).cast("double"), n), 4))


def reciprocal_rank(retrieved: Column, expected: Column, count: Column | None = None) -> Column:
    """1 by the place of the first hit, 0 without one; 1 where nothing was expected."""
    at = F.array_position(F.transform(retrieved, lambda x: F.array_contains(expected, x)), True)
    n = F.size(expected) if count is None else count
    return F.when(n == 0, F.lit(1.0)).when(at > 0, F.round(1.0 / F.nullif(at, F.lit(0)), 4)).otherwise(F.lit(0.0))


def _dcg(scores: Column) -> Column:
    return F.aggregate(F.transform(scores, lambda x, i: x / F.log2(i + 2)), F.lit(0.0), lambda a, x: a + x)


def ndcg_at(scores: Column, k: int = 10) -> Column:
    """Linear-gain NDCG against the best order of the retrieved; 1 for no scores, 0 if all are 0."""
    best = _dcg(F.slice(F.reverse(F.array_sort(scores)), 1, k))
    return F.when(F.size(scores) == 0, F.lit(1.0)).when(best == 0, F.lit(0.0)).otherwise(F.round(_dcg(F.slice(scores, 1, k)) / F.nullif(best, F.lit(0.0)), 4))


def score(events: DataFrame, ks: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """``events`` with precision, recall, reciprocal rank and NDCG. With a column ``expected_count``, ``expected_ids`` need name
    only those of the expected that were retrieved, so that no list grows with the table."""
    r, e = F.col("retrieved_ids"), F.col("expected_ids")
    n = F.col("expected_count") if "expected_count" in events.columns else None
    cols = {f"precision_{k}": precision_at(r, e, k) for k in ks} | {f"recall_{k}": recall_at(r, e, k, n) for k in ks}
    return events.withColumns(cols | {"mrr": reciprocal_rank(r, e, n), "ndcg_10": ndcg_at(F.col("relevance_scores"))})


def report(events: DataFrame, metrics: tuple[str, ...] = ("precision_5", "recall_5", "mrr", "ndcg_10")) -> DataFrame:
    """(event_type, n, mean of each metric): means leave nulls out."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(m), 4).alias(m) for m in metrics])


def latencies(events: DataFrame) -> DataFrame:
    return nearest_rank(events, "event_type", "latency_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def violations(report_: DataFrame, least: Mapping[str, float]) -> DataFrame:
    """(event_type, metric, current, threshold) where a mean is below its threshold."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("current"), F.lit(float(t)).alias("threshold")) for m, t in least.items()])
    return report_.select("event_type", F.explode(rows).alias("_v")).select("event_type", "_v.*").filter("current < threshold")
