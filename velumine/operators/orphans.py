"""References to records that do not exist (problem 1).

Parents and references are cut into equal ranges of a 64-bit hash of their key, so that ranges are even whatever the keys look
like. A range holds its parents as sorted arrays; reference batches probe them by vectorised binary search and compare the
keys themselves, so equal hashes do no harm. A range with many references (one key may hold a third of all) is split into
blocks, each of which gets the range's parents: the copies made grow with the references, not with the hot key.

Null and blank keys refer to nothing and have no row. Keys are compared without surrounding white space. A record that stands
in several rows counts once; a parent's earliest row counts for its time. Extra columns are not read.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velumine.functions.text import key
from velumine.functions.times import micros, micros_of_text
from velumine.session import Workspace

#: Parents in a range and references in a block, about.
RANGE_ROWS, BLOCK_ROWS = 5_000, 20_000
_ALWAYS = -(1 << 62)


def parents_of_nodes(nodes: DataFrame) -> DataFrame:
    """(key, created, nameless, gone) per row of ``nodes``: ``gone`` is removed_at in properties, in any notation."""
    removed = F.get_json_object("properties", "$.removed_at")
    return nodes.select(key("id").alias("key"), micros("created_at").alias("created"), micros_of_text(removed).alias("gone"))


def parents_of_memories(memories: DataFrame) -> DataFrame:
    """As ``parents_of_nodes``: a forgotten memory is gone from forgotten_at, or always without one."""
    gone = F.when(F.col("forgotten") == 1, F.coalesce(micros("forgotten_at"), F.lit(_ALWAYS)))
    return memories.select(key("id").alias("key"), micros("created_at").alias("created"), gone.alias("gone"))


def references(df: DataFrame, table_name: str, parent: str, fields: list[str]) -> DataFrame:
    """(table_name, field, record_id, period, created, parent, key) of each reference of each record."""
    records = df.select(key(F.col("id").cast("string")).alias("record_id"), F.col("created_at"), *[key(f).alias(f) for f in fields]).distinct()
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("key")) for f in fields]))
    period = F.coalesce(F.date_format("created_at", "yyyy-MM"), F.lit("unknown"))
    rows = records.select("record_id", period.alias("period"), micros("created_at").alias("created"), pairs.alias("_f"))
    return rows.filter("_f.key is not null").select(F.lit(table_name).alias("table_name"), "_f.field", "record_id", "period", "created", F.lit(parent).alias("parent"), "_f.key")


def _probe(refs: pa.Table, parents: pa.Table) -> pa.Table:
    """Orphans among ``refs``: missing, deleted or late against the sorted ``parents``."""
    order = np.argsort(parents.column("_h").to_numpy(), kind="stable")
    ph = parents.column("_h").to_numpy()[order]
    pkey = parents.column("key").combine_chunks().take(pa.array(order))
    early = parents.column("early").to_numpy()[order]
    gone = parents.column("gone").to_numpy()[order]
    rh = refs.column("_h").to_numpy()
    rkey = refs.column("key").combine_chunks()
    at = np.searchsorted(ph, rh)
    hit = np.full(len(rh), -1, dtype=np.int64)
    open_ = np.arange(len(rh))
    while len(open_):  # once, and once more for each pair of keys with one hash
        open_ = open_[(at[open_] < len(ph))]
        open_ = open_[ph[at[open_]] == rh[open_]] if len(ph) else open_[:0]
        if not len(open_):
            break
        same = pa.compute.equal(rkey.take(pa.array(open_)), pkey.take(pa.array(at[open_]))).to_numpy(zero_copy_only=False)
        hit[open_[same]] = at[open_[same]]
        open_ = open_[~same]
        at[open_] += 1
    made = refs.column("created").to_numpy()  # the greatest integer stands for null
    timed = made != np.iinfo(np.int64).max
    found = hit >= 0
    h = np.where(found, hit, 0)
    g = gone[h] if len(gone) else np.zeros(len(rh), dtype=np.int64)
    e = early[h] if len(early) else np.zeros(len(rh), dtype=np.int64)
    deleted = found & timed & (g <= made)
    late = found & timed & ~deleted & (e > made)
    bad = np.flatnonzero(~found | deleted | late)
    reason = np.where(~found, "missing", np.where(deleted, "deleted", "late"))[bad]
    out = refs.select(["table_name", "field", "record_id", "period"]).take(pa.array(bad))
    return out.append_column("reason", pa.array(reason, pa.string()))


_OUT = "table_name string, field string, record_id string, period string, reason string"


def orphans(refs: DataFrame, parents: dict[str, DataFrame], workspace: Workspace, range_rows: int = RANGE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(table_name, field, record_id, period, reason) of the orphans among ``refs``."""
    rows = None
    for name, p in parents.items():
        p = p.filter("key is not null").select(F.lit(name).alias("parent"), "key", "created", "gone")
        rows = p if rows is None else rows.unionByName(p)
    # A record is late if all its rows are, so one row without a time keeps it from being late.
    early = F.when(F.count("created") == F.count(F.lit(1)), F.min("created")).otherwise(F.lit(_ALWAYS))
    ends = rows.groupBy("parent", "key").agg(early.alias("early"), F.coalesce(F.min("gone"), F.lit((1 << 63) - 1)).alias("gone"))
    many = rows.count()
    ranges = max(refs.sparkSession.sparkContext.defaultParallelism, -(-many // range_rows))
    # Equal ranges of the signed 64-bit hash, by its upper half.
    span = F.shiftrightunsigned((F.shiftright("_h", 32) + F.lit(1 << 31)) * F.lit(ranges).cast("long"), 32).cast("int")
    held = ends.withColumn("_h", F.xxhash64("parent", "key")).withColumn("_r", span)
    asked = workspace.keep(refs.withColumn("_h", F.xxhash64("parent", "key")).withColumn("_r", span).withColumn("created", F.coalesce("created", F.lit((1 << 63) - 1))))
    blocks = asked.groupBy("_r").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_nb"))
    asked = asked.join(blocks, "_r").withColumn("_b", F.pmod(F.xxhash64("record_id", "field"), F.col("_nb")).cast("int"))
    held = held.join(blocks, "_r").withColumn("_b", F.explode(F.expr("sequence(0, _nb - 1)")))
    left = asked.select("_r", "_b", "_h", "key", "created", "table_name", "field", "record_id", "period").groupBy("_r", "_b")
    right = held.select("_r", "_b", "_h", "key", "early", "gone").groupBy("_r", "_b")
    return left.cogroup(right).applyInArrow(_probe, _OUT)


def table_orphans(edges: DataFrame, nodes: DataFrame, memory_edges: DataFrame, memories: DataFrame, workspace: Workspace) -> DataFrame:
    """Orphans of edges against nodes and of memory relations against memories."""
    refs = references(edges, "edges", "nodes", ["source_id", "target_id"]).unionByName(references(memory_edges, "memory_edges", "memories", ["target_id"]))
    return orphans(refs, {"nodes": parents_of_nodes(nodes), "memories": parents_of_memories(memories)}, workspace)
