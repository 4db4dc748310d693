"""Cutting texts into chunks, with offsets in bytes or characters and links to parents.

Strategies are column expressions over arrays, so a chunking is one scan and one generate; the hierarchy, whose offsets are
running sums, reads each text once over Arrow batches. Null texts give no chunks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The boundaries of paragraphs and sentences; white space is that of ASCII.
PARAGRAPH = r"\n\s*\n"
SENTENCE = r"(?<=[.!?])\s+(?=[A-Z])"


_BLANK = " \t\n\r\x0b\x0c"


def located(text: str, separator: re.Pattern[str]) -> Iterator[tuple[str, int, int]]:
    """(part, start, end) of the parts between separators, without surrounding white space; offsets in bytes."""
    at = byte = 0
    for m in [*separator.finditer(text), None]:
        piece = text[at : m.end() if m else len(text)]
        bare = piece.lstrip(_BLANK)
        part = bare.rstrip(_BLANK)
        size = len(piece.encode("utf-8", "surrogatepass"))
        if part:
            start = byte + len(piece) - len(bare)  # white space is one byte each
            yield part, start, start + len(part.encode("utf-8", "surrogatepass"))
        byte += size
        at += len(piece)


def _parts(text: Column, pattern: str) -> Column:
    trimmed = F.transform(F.split(text, pattern), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(trimmed, lambda x: x != F.lit(""))


def hierarchy(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Document, paragraph and sentence chunks of each text: (id, doc_id, parent_id, level, text, start_offset, end_offset).

    Offsets are UTF-8 bytes. A sentence's parent is its paragraph, a paragraph's the document.
    """
    doc = df.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text).alias("_t")).filter("_t is not null and _t <> ''")
    paragraph, sentence = re.compile(PARAGRAPH, re.ASCII), re.compile(SENTENCE, re.ASCII)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc_id, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                root = f"{doc_id}:d:0"
                rows.append((root, doc_id, None, "document", t, 0, len(t.encode("utf-8", "surrogatepass"))))
                for part, start, end in located(t, paragraph):
                    name = f"{doc_id}:p:{start}"
                    rows.append((name, doc_id, root, "paragraph", part, start, end))
                    rows += [(f"{doc_id}:s:{start + a}", doc_id, name, "sentence", s, start + a, start + z) for s, a, z in located(part, sentence)]
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.string()] * 5 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["id", "doc_id", "parent_id", "level", "text", "start_offset", "end_offset"])

    return doc.mapInArrow(run, "id string, doc_id string, parent_id string, level string, text string, start_offset int, end_offset int")


def paragraphs(df: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = 50) -> DataFrame:
    """(id, chunk_index, text): paragraphs of at least ``least`` characters."""
    kept = F.filter(_parts(F.col(text), PARAGRAPH), lambda x: F.length(x) >= least)
    return df.select(F.col(id_col), F.posexplode(kept).alias("chunk_index", "text"))


def packed(df: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 500) -> DataFrame:
    """(id, chunk_index, text): sentences joined greedily while they fit in ``size`` characters; none is lost."""
    zero = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, s: Column) -> Column:
        joined = F.when(acc["open"] == "", s).otherwise(F.concat(acc["open"], F.lit(" "), s))
        fits = (acc["open"] == "") | (F.length(joined) <= size)
        return F.struct(F.when(fits, joined).otherwise(s).alias("open"), F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"))

    chunks = F.aggregate(_parts(F.col(text), SENTENCE), zero, step, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))
    return df.select(F.col(id_col), F.posexplode(chunks).alias("chunk_index", "text"))


def windows(df: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 500, overlap: int = 50, least: int = 50) -> DataFrame:
    """(id, chunk_index, start, text): windows of ``size`` characters with ``overlap``; short ones are dropped after numbering."""
    step = max(size - overlap, 1)
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(step)))
    rows = df.select(F.col(id_col), F.col(text).alias("_t"), F.posexplode(starts).alias("chunk_index", "start"))
    return rows.withColumn("text", F.substring(F.col("_t"), F.col("start") + 1, F.lit(size))).filter(F.length("text") >= least).select(id_col, "chunk_index", "start", "text")


def markdown(df: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = 1) -> DataFrame:
    """(id, chunk_index, parent_index, heading_level, title, text): parts before each heading; one under a deeper heading has
    the part before it as parent."""
    parts = F.split(F.regexp_replace(F.col(text), r"\r\n?", "\n"), r"(?m)^(?=#{1,6}\s)")
    rows = df.select(F.col(id_col), F.posexplode(F.filter(parts, lambda x: F.length(F.regexp_replace(x, r"^\s+|\s+$", "")) >= least)).alias("chunk_index", "text"))
    hashes = F.regexp_extract("text", r"^(#{1,6})\s", 1)
    title = F.regexp_replace(F.regexp_extract("text", r"^#{1,6}\s+([^\n]*)", 1), r"\s+$", "")
    depth = F.length(hashes)
    parent = F.when((depth > 1) & (F.col("chunk_index") > 0), F.col("chunk_index") - 1)
    return rows.select(id_col, "chunk_index", parent.alias("parent_index"), depth.alias("heading_level"), title.alias("title"), "text")


STRATEGIES = {"paragraph": paragraphs, "sentence": packed, "fixed": windows, "sliding": windows, "markdown": markdown, "transcript": packed}


def chunk(df: DataFrame, strategy: str, most: int | None = None, **options) -> DataFrame:
    """Chunks by a strategy's name, at most ``most`` of a text if given."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; one of {sorted(STRATEGIES)}")
    out = STRATEGIES[strategy](df, **options)
    return out if most is None else out.filter(F.col("chunk_index") < most)


def strategy_for(path: str) -> str:
    """The strategy for a file by its extension."""
    return "markdown" if path.lower().endswith((".md", ".markdown", ".adoc", ".rst")) else "paragraph"
