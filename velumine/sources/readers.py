"""Readers of text, HTML, DOCX and binary files, and writers of partitioned tables."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions read as text.
TEXT_EXTENSIONS = ("txt", "md", "rst", "org", "adoc", "xml", "json", "yaml", "yml", "toml", "csv", "log")
#: Entities decoded by ``strip_html``, in the order they are replaced.
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"))


def read_text(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, text, bytes, lines) of whole files. A path may use any file system that Spark reads."""
    rows = spark.read.text(list(path) if not isinstance(path, str) else path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.select("path", "text", F.octet_length("text").alias("bytes"), F.size(F.split("text", "\n")).alias("lines"))


def read_batch(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, status, text, error): one row per path asked for. ``status`` is ``ok`` or ``error``, for files that are missing or
    are no UTF-8 text; one of them does not keep the others from being read."""
    asked = spark.createDataFrame([(p,) for p in dict.fromkeys(paths)], "path string")
    jvm, there = spark.sparkContext._jvm, []
    for p in dict.fromkeys(paths):
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            there.append(p)
    if not there:
        return asked.select("path", F.lit("error").alias("status"), F.lit(None).cast("string").alias("text"), F.lit("not found").alias("error"))
    bare = lambda c: F.regexp_replace(c, r"^file:/+", "/")
    files = spark.read.format("binaryFile").load(there).select(bare(F.col("path")).alias("_k"), "content")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    rows = asked.withColumn("_k", bare(F.col("path"))).join(files, "_k", "left")
    error = F.when(F.col("content").isNull(), "not found").when(text.isNull(), "not UTF-8")
    return rows.select("path", F.when(error.isNull(), "ok").otherwise("error").alias("status"), text.alias("text"), error.alias("error"))


def read_prefix(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """``read_batch`` of all files below a prefix, on any Hadoop file system, listed by the readers and not by the driver."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root.rstrip('/')}/{prefix}*")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return files.select("path", F.when(text.isNotNull(), "ok").otherwise("error").alias("status"), text.alias("text"), F.when(text.isNull(), "not UTF-8").alias("error"))


def strip_html(text: Column) -> Column:
    """Text of HTML: scripts and styles dropped, tags and numeric entities to blanks, five entities decoded, blanks collapsed."""
    t = F.regexp_replace(text, r"(?is)<(script|style)\b[^>]*>.*?</(?:script|style)>", " ")
    t = F.regexp_replace(t, "<[^>]+>", " ")
    for name, char in _ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.btrim(F.regexp_replace(F.regexp_replace(t, r"&#\d+;", " "), r"\s+", " "))


def read_html(spark: SparkSession, path: str) -> DataFrame:
    return read_text(spark, path).withColumn("text", strip_html(F.col("text")))


def docx_text(raw: bytes) -> str | None:
    """Text runs of a DOCX file, blanks collapsed; null where it isn't one."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            xml = z.read("word/document.xml").decode("utf-8", "replace")
    except (zipfile.BadZipFile, KeyError, OSError):
        return None
    return re.sub(r"\s+", " ", "".join(re.findall(r"<w:t(?:\s[^>]*)?>(.*?)</w:t>", xml, re.S))).strip()


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": [docx_text(x) for x in b["content"]]})

    return files.mapInPandas(run, "path string, text string")


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified, kind) of any files, with the kind of medium by extension."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(ext.isin("png", "jpg", "jpeg", "gif", "webp"), "image").when(ext.isin("mp3", "wav", "ogg", "flac"), "audio").when(ext.isin("mp4", "webm", "mov", "mkv"), "video").otherwise("file")
    return spark.read.format("binaryFile").load(path).select("path", "length", F.col("modificationTime").alias("modified"), kind.alias("kind"))


def scan_status(df: DataFrame) -> DataFrame:
    """(file, rows): how many rows each file of a scan gave."""
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"))


def write_shards(df: DataFrame, path: str, by: str = "shard_id", mode: str = "append", most_rows: int = 10_000) -> None:
    """Parquet partitioned by shard, at most ``most_rows`` rows a file."""
    df.write.mode(mode).option("maxRecordsPerFile", most_rows).partitionBy(by).parquet(path)


def delete_rows(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    return df.join(ids.select(id_col).distinct(), id_col, "left_anti")


def upsert(df: DataFrame, new: DataFrame, id_col: str) -> DataFrame:
    """``df`` with the rows of ``new`` in place of those of the same id."""
    return delete_rows(df, new, id_col).unionByName(new)


class Storage:
    """put, get, delete, list and exists on any Hadoop file system (``file:``, ``s3a:``, ...)."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, key: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}".rstrip("/"))

    def put(self, key: str, local: str) -> None:
        self._fs.mkdirs(self._path(key).getParent())
        self._fs.copyFromLocalFile(False, True, self._jvm.org.apache.hadoop.fs.Path(local), self._path(key))

    def get(self, key: str, local: str) -> None:
        self._fs.copyToLocalFile(False, self._path(key), self._jvm.org.apache.hadoop.fs.Path(local), True)

    def delete(self, key: str) -> bool:
        return self._fs.delete(self._path(key), True)

    def exists(self, key: str) -> bool:
        return self._fs.exists(self._path(key))

    def list(self, key: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(key))) if self.exists(key) else []
