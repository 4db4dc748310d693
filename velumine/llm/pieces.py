"""Splitting oversized items at natural boundaries (problem 4), by agglomerative merging.

A text is first cut into atomic segments at its natural boundaries: paragraphs, lines, sentence ends, then clauses and words
inside what is still too long. Adjacent segments lie in a heap by the strength of the boundary between them and their
combined size; the weakest boundary is merged first while the combined size and the overlap fit. Only a run without white
space longer than the limit is cut inside, between characters. Sizes and offsets are UTF-8 bytes.

Null and empty texts, and texts within the limit, give no pieces. A piece never exceeds the limit, its overlap included: the
overlap is what room the limit leaves, at most ``overlap`` bytes, and starts behind white space if there is any in it.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velumine.functions.text import key, level
from velumine.session import spread

#: Boundary strengths.
FORCED, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(6)
_COARSE = re.compile(r"(?P<p>\s*\n[^\S\n]*\n\s*)|(?P<l>[^\S\n]*(?:\r\n?|\n)\s*)|(?P<s>(?<=[.!?…。！？])[\"'”’»)\]]*\s+|(?<=[。！？]))")
_CLAUSE = re.compile(r"(?<=[,;:])\s+")
_WORD = re.compile(r"\s+")
_RUN = re.compile(r"\S+")


class Piece(NamedTuple):
    start: int  # in bytes, with the overlap
    end: int
    overlap: int  # bytes repeated from the piece before
    forced: bool  # a cut of it lies inside a run without white space longer than the limit
    boundary: int  # strength of the boundary at its end
    text: str


def _cut(s: str, pattern: re.Pattern[str]) -> list[str]:
    out, at = [], 0
    for m in pattern.finditer(s):
        if m.end() > at and m.end() < len(s):
            out.append(s[at : m.end()])
            at = m.end()
    out.append(s[at:])
    return out


def _size(s: str) -> int:
    return len(s) if s.isascii() else len(s.encode("utf-8", "surrogatepass"))


def _inside(s: str, limit: int) -> list[str]:
    """``s`` in parts of at most ``limit`` bytes, between characters."""
    raw, out, at = s.encode("utf-8", "surrogatepass"), [], 0
    while at < len(raw):
        end = min(at + limit, len(raw))
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        out.append(raw[at:end].decode("utf-8", "surrogatepass"))
        at = end
    return out


def _long_runs(text: str, limit: int) -> list[tuple[int, int]]:
    """(start, end) in bytes of the runs without white space longer than ``limit`` bytes."""
    out, at, done = [], 0, 0
    for m in _RUN.finditer(text):
        if 4 * (m.end() - m.start()) > limit and (n := _size(m.group())) > limit:
            at += _size(text[done : m.start()])
            out.append((at, at + n))
            at, done = at + n, m.end()
    return out


def _atoms(text: str, limit: int, most: int) -> list[tuple[str, int, int]]:
    """(segment, bytes, strength of the boundary behind it); a segment is within ``limit`` and, if it can be, ``most``."""
    coarse: list[tuple[str, int]] = []
    at = 0
    for m in _COARSE.finditer(text):
        if at < m.end() < len(text):
            coarse.append((text[at : m.end()], PARAGRAPH if m.group("p") else LINE if m.group("l") else SENTENCE))
            at = m.end()
    coarse.append((text[at:], PARAGRAPH))
    out: list[tuple[str, int, int]] = []

    def add(s: str, strength: int, way: int) -> None:
        n = _size(s)
        if n <= most:
            out.append((s, n, strength))
        elif way == 0 or way == 1:
            parts = _cut(s, _CLAUSE if way == 0 else _WORD)
            for k, part in enumerate(parts):
                last = k == len(parts) - 1
                add(part, strength if last else (CLAUSE if way == 0 else WORD), way + 1)
        else:
            run = s.rstrip()
            if _size(run) <= limit:
                if n <= limit:
                    out.append((s, n, strength))
                else:  # a word and more white space than fits
                    parts = [run, *_inside(s[len(run) :], most)] if run else _inside(s, most)
                    out.extend((p, _size(p), WORD if k < len(parts) - 1 else strength) for k, p in enumerate(parts))
            else:
                parts = _inside(run, most) + (_inside(s[len(run) :], most) if len(run) < len(s) else [])
                body = len(_inside(run, most))
                out.extend((p, _size(p), FORCED if k < body - 1 else WORD if k < len(parts) - 1 else strength) for k, p in enumerate(parts))

    for s, strength in coarse:
        add(s, strength, 0)
    return out


def split(text: str, limit: int, overlap: int) -> list[Piece]:
    """Pieces of ``text``, none if it is within ``limit`` bytes."""
    if not text or _size(text) <= limit:
        return []
    most = max(1, limit - overlap)
    atoms = _atoms(text, limit, most)
    n = len(atoms)
    size = [a[1] for a in atoms]
    strength = [a[2] for a in atoms]  # behind segment i
    nxt, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    version = [0] * n
    heap = [(strength[i], size[i] + size[i + 1], i, 0, 0) for i in range(n - 1)]
    heapq.heapify(heap)
    last = list(range(n))  # last atom of the segment that starts at i
    while heap:
        _, both, i, vi, vj = heapq.heappop(heap)
        j = nxt[i]
        if not alive[i] or j >= n or version[i] != vi or version[j] != vj or both > most:
            continue
        size[i], strength[i], last[i] = both, strength[j], last[j]
        alive[j] = False
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
            version[i] += 1
            heapq.heappush(heap, (strength[i], size[i] + size[nxt[i]], i, version[i], version[nxt[i]]))
        else:
            version[i] += 1
        if prev[i] >= 0:
            p = prev[i]
            heapq.heappush(heap, (strength[p], size[p] + size[i], p, version[p], version[i]))
    raw = text.encode("utf-8", "surrogatepass")
    out: list[Piece] = []
    runs = _long_runs(text, limit)
    # A cut between sentences lies inside a run too where no white space follows the mark.
    inside = lambda cut: any(a < cut < z for a, z in runs)
    at, i = 0, 0
    while i < n:
        end = at + size[i]
        start = at
        if out:
            start = max(at - min(overlap, limit - size[i]), out[-1].start + out[-1].overlap)
            while start < at and raw[start] & 0xC0 == 0x80:
                start += 1
            m = re.search(rb"\s+(?=\S)", raw[start:at])
            if m:
                start += m.end()
        out.append(Piece(start, end, at - start, inside(at) or inside(end), strength[i], raw[start:end].decode("utf-8", "surrogatepass")))
        at, i = end, nxt[i]
    return out


def split_items(df: DataFrame, table_name: str, id_col: str, text_col: str, limit: int, overlap: int, level_col: Column, start_col: Column) -> DataFrame:
    """Pieces of every item over ``limit`` bytes, in the terms of chunks.

    (table_name, item_id, piece, level, start_offset, end_offset, overlap, forced, boundary, text). Offsets count from
    ``start_col``, the item's own start in its document; where that is null, from the start of the item. An item that
    stands in several rows counts once.
    """
    long = df.select(key(F.col(id_col).cast("string")).alias("item_id"), level_col.alias("level"), F.coalesce(start_col.cast("long"), F.lit(0).cast("long")).alias("_base"), F.col(text_col).alias("_text"))
    long = spread(long).filter(F.octet_length("_text") > limit).dropDuplicates(["item_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["table_name", "item_id", "piece", "level", "start_offset", "end_offset", "overlap", "forced", "boundary", "text"]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.string()]
        for b in batches:
            rows = []
            for item, lev, base, text in zip(*(c.to_pylist() for c in b.columns)):
                rows += [(table_name, item, k, lev, base + p.start, base + p.end, p.overlap, p.forced, p.boundary, p.text) for k, p in enumerate(split(text, limit, overlap))]
            cols = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return long.mapInArrow(run, "table_name string, item_id string, piece int, level string, start_offset long, end_offset long, overlap int, forced boolean, boundary int, text string")


def pieces(documents: DataFrame, chunks: DataFrame, document_limit: int = 6000, chunk_limit: int = 1200, overlap: int = 200) -> DataFrame:
    """Pieces of documents and of paragraph and sentence chunks that exceed their limits."""
    docs = split_items(documents, "documents", "doc_id", "text", document_limit, overlap, F.lit("document"), F.lit(0))
    small = chunks.filter(level("level").isin("paragraph", "sentence"))
    return docs.unionByName(split_items(small, "chunks", "id", "text", chunk_limit, overlap, level("level"), F.col("start_offset")))
