"""The front end: what kind of query a text is, and its execution over a folder of tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from velumine.operators import indexes, ingest, relational, search
from velumine.sources.tables import load

_SEMANTIC = re.compile(r"^\s*SEMANTIC\s+'((?:[^']|'')*)'\s*(?:WHERE\s+(.*?))?\s*(?:LIMIT\s+(\d+))?\s*;?\s*$", re.I | re.S)
_VECTOR = re.compile(r"\b(?:vec_distance\w*|list_cosine_similarity|semantic)\b|<->|\bsimilar\s+to\s+vector\b", re.I)
_COMPLEX = re.compile(r"\bjoin\b|\bover\s*\(|\bwindow\b|\bhaving\b|^\s*with\b|\(\s*select\b|\bunion\b|\bintersect\b|\bexcept\b|\bgroup\s+by\b", re.I)
_AGGREGATE = re.compile(r"\b(?:count|sum|avg|min|max|stddev\w*|var\w*|median|percentile\w*)\s*\(", re.I)


def classify(text: str, engine: str | None = None) -> str:
    """hybrid, vector, analytics or simple; ``engine`` forces one."""
    if engine:
        return engine
    if _VECTOR.search(text):
        return "hybrid" if re.search(r"\bwhere\b", text, re.I) else "vector"
    if _COMPLEX.search(text) or len(_AGGREGATE.findall(text)) > 1:
        return "analytics"
    return "simple"


def parse_semantic(text: str) -> tuple[str, str | None, int | None] | None:
    """(query, predicate, limit) of ``SEMANTIC '...' [WHERE ...] [LIMIT n]``."""
    m = _SEMANTIC.match(text)
    return None if m is None else (m.group(1).replace("''", "'"), m.group(2) or None, int(m.group(3)) if m.group(3) else None)


def hash_embedding(text: str, dims: int = 64) -> list[float]:
    """The embedding used without a model: hashed word counts at unit length."""
    return ingest.hash_vector(text, dims)


class Engine:
    """SQL, vector and hybrid queries over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str, table: str = "embeddings", id_col: str = "vec_id", vector: str = "embedding", embed: Callable[[str], Sequence[float]] = hash_embedding) -> None:
        self.spark, self.sf_dir, self.table, self.id_col, self.vector, self.embed = spark, sf_dir, table, id_col, vector, embed

    def query(self, text: str, args: Mapping[str, object] | None = None, k: int = 10) -> DataFrame:
        """Runs a text by its kind. SQL is global: no shard sees a part of a group or of a window."""
        parsed = parse_semantic(text)
        if parsed is not None:
            asked, where, limit = parsed
            return self.search(asked, limit or k, where)
        return relational.sql(self.spark, self.sf_dir, text, args)

    def search(self, text: str, k: int = 10, where: str | None = None, floor: float | None = None) -> DataFrame:
        rows = load(self.spark, self.sf_dir, self.table)
        return search.knn(rows, list(self.embed(text)), k, id_col=self.id_col, vector=self.vector, where=where, floor=floor)

    def index(self, strategy: str = "exact", **options) -> indexes.Index:
        rows = load(self.spark, self.sf_dir, self.table)
        return indexes.create(strategy, id_col=self.id_col, vector=self.vector, **options).fit(rows)
