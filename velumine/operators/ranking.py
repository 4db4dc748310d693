"""Scorers, fusion and keyword ranking as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velumine.session import Workspace

#: Default weights of the scorers.
WEIGHTS = {"vector": 0.6, "pagerank": 0.2, "freshness": 0.1, "text_match": 0.1}


def vector_score(similarity: Column) -> Column:
    """The similarity, at least 0; 0 where there is none."""
    return F.greatest(F.lit(0.0), F.coalesce(similarity, F.lit(0.0)))


def pagerank_score(pagerank: Column) -> Column:
    return F.least(F.lit(1.0), F.coalesce(pagerank, F.lit(0.0)) / 100.0)


def freshness_score(created_at: Column, now: Column, half_life_days: float = 30.0) -> Column:
    """Halves each ``half_life_days`` whole days; 0.5 without a time."""
    days = F.timestamp_diff("DAY", created_at, now)
    return F.when(created_at.isNull(), F.lit(0.5)).otherwise(F.pow(F.lit(0.5), days / F.lit(half_life_days)))


def text_match_score(text: Column, terms: Sequence[str]) -> Column:
    """Share of the terms that the text contains, without regard to case."""
    if not terms:
        return F.lit(0.0)
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = sum((F.when(F.contains(low, F.lit(t.lower())), 1.0).otherwise(0.0) for t in terms), F.lit(0.0))
    return hits / F.lit(float(len(terms)))


def weighted_sum(scores: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    out = F.lit(0.0)
    for name, score in scores.items():
        out = out + F.lit(float(weights.get(name, 0.0))) * F.coalesce(score, F.lit(0.0))
    return out


def max_score(scores: Mapping[str, Column]) -> Column:
    return F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))


def global_rank(df: DataFrame, score: str, id_col: str, rank: str, workspace: Workspace) -> DataFrame:
    """``df`` with its place by a score, the highest first and nulls last, ties by id. Rows are ordered in ranges, counted, and
    numbered within their range behind the counts of those before, so no task sees all rows. The ranges are kept, since they
    are drawn from a sample and must not change between the count and the numbering."""
    order = [F.desc_nulls_last(score), F.asc(id_col)]
    ranged = workspace.keep(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row per range
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    placed = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return placed.join(F.broadcast(before), "_part").withColumn(rank, F.col("_before") + F.col("_r")).drop("_part", "_before", "_r")


def reciprocal_rank_fusion(df: DataFrame, scores: Sequence[str], id_col: str, k: int = 60, workspace: Workspace | None = None) -> DataFrame:
    """``df`` with ``rrf``: the sum of 1 / (k + rank) over the scores. Ranks are global."""
    out, total = df, F.lit(0.0)
    work = workspace or Workspace(df.sparkSession, "rrf")
    for i, s in enumerate(scores):
        out = global_rank(out, s, id_col, f"_rank{i}", work)
        total = total + F.lit(1.0) / (F.lit(float(k)) + F.col(f"_rank{i}"))
    return out.withColumn("rrf", total).drop(*[f"_rank{i}" for i in range(len(scores))])


@dataclass
class Ranker:
    """Scorers, a fusion and a least score. A fusion is "weighted_sum", "max", "rrf" or a function of DataFrames."""

    scorers: dict[str, Callable[[DataFrame], Column]]
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    fusion: str | Callable[[DataFrame, Mapping[str, float]], DataFrame] = "weighted_sum"
    min_score: float | None = None

    def rank(self, df: DataFrame, id_col: str) -> DataFrame:
        named = {f"score_{n}": f(df) for n, f in self.scorers.items()}
        out = df.withColumns(named)
        cols = {n: F.col(f"score_{n}") for n in self.scorers}
        if callable(self.fusion):
            out = self.fusion(out, self.weights)
        elif self.fusion == "weighted_sum":
            out = out.withColumn("score", weighted_sum(cols, self.weights))
        elif self.fusion == "max":
            out = out.withColumn("score", max_score(cols))
        elif self.fusion == "rrf":
            out = reciprocal_rank_fusion(out, list(named), id_col).withColumnRenamed("rrf", "score")
        else:
            raise ValueError(f"unknown fusion {self.fusion!r}")
        if self.min_score is not None:
            out = out.filter(F.col("score") >= self.min_score)
        return out.orderBy(F.desc("score"), id_col)


def terms_of(text: Column) -> Column:
    """Lower-case words of more than two characters."""
    return F.filter(F.split(F.lower(text), r"\W+"), lambda x: F.length(x) > 2)


def _equals(term: str) -> Callable[[Column], Column]:
    return lambda x: x == F.lit(term)


def bm25(df: DataFrame, terms: Sequence[str], id_col: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, bm25) of the rows that hold a term. Term counts are taken row by row without exploding the texts; the corpus
    statistics are one aggregate row, broadcast."""
    wanted = [t.lower() for t in dict.fromkeys(terms)]
    words = df.select(id_col, terms_of(F.coalesce(F.col(text), F.lit(""))).alias("_w"))
    counts = words.select(id_col, F.size("_w").alias("_len"), *[F.size(F.filter("_w", _equals(t))).alias(f"_tf{i}") for i, t in enumerate(wanted)])
    stats = counts.agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(wanted))])
    both = counts.filter(" or ".join(f"_tf{i} > 0" for i in range(len(wanted)))).crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(wanted)):
        tf, n = F.col(f"_tf{i}"), F.col(f"_df{i}")
        idf = F.ln(1 + (F.col("_n") - n + 0.5) / (n + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_len") / F.col("_avg")))
    return both.select(id_col, score.alias("bm25"))
