"""Corpus encoding with public tokenizers (problem 8).

Texts are encoded by the ``tokenizers`` library over Arrow batches. The tokenizer file is a parameter; it is sent to executors
that do not have it, and opened once in each Python worker. Empty and null texts have an empty list of ids. Strings of special
tokens are ordinary text. Offsets are in bytes and in characters: a byte's character is the number of characters that begin up to
it, so tokens that share a split character overlap in characters and not in bytes.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from velumine.session import spread

TOKENIZER_DIR = os.environ.get("VELUMINE_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = f"{TOKENIZER_DIR}/byte_bpe_50k.json"
#: Texts handed to the library at once; bounds the memory that encodings take.
_SLICE = 64


def send(spark: SparkSession, path: str) -> None:
    """Gives the tokenizer file to the executors, once a session."""
    sent = spark.sparkContext.__dict__.setdefault("_velumine_tokenizers", set())
    if path not in sent:
        spark.sparkContext.addFile(path)
        sent.add(path)


def _here(path: str) -> str:
    """The file on this machine: at its path, or as it was sent."""
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(_here(path))
    t.encode_special_tokens = True
    return t


def _slices(texts: list[str | None]) -> Iterator[list[str]]:
    for i in range(0, len(texts), _SLICE):
        yield [t or "" for t in texts[i : i + _SLICE]]


def encode_texts(texts: list[str | None], path: str = BYTE_BPE) -> list[list[int]]:
    """Ids of each text, without special tokens."""
    t = _tokenizer(path)
    return [e.ids for part in _slices(texts) for e in t.encode_batch_fast(part, add_special_tokens=False)]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = BYTE_BPE) -> DataFrame:
    """(id, ids) of every row of ``df``. Nulls and empty texts give an empty list; an empty table gives no rows."""
    source = spread(df.select(id_col, text_col))
    send(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(path)
        for b in batches:
            parts, ends, n = [], [0], 0
            for part in _slices(b.column(1).to_pylist()):
                for e in t.encode_batch_fast(part, add_special_tokens=False):
                    ids = np.asarray(e.ids, dtype=np.int32)
                    n += len(ids)
                    parts.append(ids)
                    ends.append(n)
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.asarray(ends, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[id_col, "ids"])

    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = BYTE_BPE) -> DataFrame:
    """(id, n_tokens) of every row; null and empty texts have none."""
    source = spread(df.select(id_col, text_col))
    send(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(path)
        for b in batches:
            n = [len(e) for part in _slices(b.column(1).to_pylist()) for e in t.encode_batch_fast(part, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32())], names=[id_col, "n_tokens"])

    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, n_tokens int")


@lru_cache(maxsize=1)
def byte_table() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary, reversed: printable bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def token_bytes(path: str = BYTE_BPE) -> dict[int, bytes]:
    """The bytes of every id of a byte-level vocabulary; those of added tokens are their text."""
    with open(_here(path), encoding="utf-8") as f:
        file = json.load(f)
    table = byte_table()
    added = {t["id"]: t["content"].encode() for t in file.get("added_tokens") or ()}
    return {i: bytes(table[c] for c in token) for token, i in file["model"]["vocab"].items() if i not in added and all(c in table for c in token)} | added


def decode_ids(ids: list[int], path: str = BYTE_BPE) -> str:
    """The text of ``ids``. A character split between tokens is whole again, since bytes are joined before decoding;
    a list cut inside a character ends in U+FFFD."""
    table = token_bytes(path)
    return b"".join(table[i] for i in ids).decode("utf-8", "replace")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = BYTE_BPE) -> DataFrame:
    """(id, text) from lists of ids; a null list gives an empty text."""
    source = df.select(id_col, ids_col)
    send(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [decode_ids(x or [], path) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, text string")


def byte_offsets(text: str, path: str = BYTE_BPE) -> list[tuple[int, int, int]]:
    """(id, start, end) in UTF-8 bytes of the text for each token, from the lengths in the byte table: tokens of a
    byte-level vocabulary cover the text without gaps, so their ends are running sums."""
    table, out, at = token_bytes(path), [], 0
    for i in encode_texts([text], path)[0]:
        out.append((i, at, at + len(table[i])))
        at += len(table[i])
    return out


def char_offsets(text: str, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, behind the last) characters that the bytes [start, end) of ``text`` touch."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    begun = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]  # characters that begin before each byte
    inside = np.r_[(raw & 0xC0) == 0x80, False]
    return begun[start] - inside[start], begun[end]


def encode_with_offsets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = BYTE_BPE) -> DataFrame:
    """(id, place, token_id, start_byte, end_byte, start_char, end_char): one row per token."""
    source = spread(df.select(id_col, text_col))
    send(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_col, "place", "token_id", "start_byte", "end_byte", "start_char", "end_char"]
        table = token_bytes(path)
        size = np.zeros(max(table, default=0) + 1, dtype=np.int64)
        size[list(table)] = [len(v) for v in table.values()]
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i in range(0, len(texts), _SLICE):
                part = texts[i : i + _SLICE]
                ids = [np.asarray(x, dtype=np.int64) for x in encode_texts(part, path)]
                rows = [(x, np.cumsum(size[x]) - size[x], np.cumsum(size[x])) for x in ids]
                chars = [char_offsets(t, a, z) for t, (_, a, z) in zip(part, rows)]
                n = np.array([len(x) for x in ids], dtype=np.int64)
                flat = lambda parts: pa.array(np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int32))
                keys = b.column(0).slice(i, len(part)).take(pa.array(np.repeat(np.arange(len(part)), n)))
                cols = [flat([np.arange(k) for k in n]), *(flat([r[j] for r in rows]) for j in range(3)), *(flat([c[j] for c in chars]) for j in range(2))]
                yield pa.RecordBatch.from_arrays([keys, *cols], names=names)

    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, place int, token_id int, start_byte int, end_byte int, start_char int, end_char int")
