"""Orphan references against a direct check, with dirty keys, hot keys and equal hashes apart."""

from __future__ import annotations

from datetime import datetime, timedelta

from velumine.operators import orphans as O
from velumine.session import Workspace

T0 = datetime(2025, 3, 1)
NODE = "id string, properties string, created_at timestamp_ntz, _h long, key string"
EDGE = "id string, source_id string, target_id string, created_at timestamp_ntz, period string"
MEMORY = "id string, forgotten int, forgotten_at timestamp_ntz, created_at timestamp_ntz"


def found(spark, nodes, edges, memories=(), relations=(), **kw):
    n, e = spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)
    m, r = spark.createDataFrame(memories, MEMORY), spark.createDataFrame(relations, "id string, target_id string, created_at timestamp_ntz")
    refs = O.references(e, "edges", "nodes", ["source_id", "target_id"]).unionByName(O.references(r, "memory_edges", "memories", ["target_id"]))
    out = O.orphans(refs, {"nodes": O.parents_of_nodes(n), "memories": O.parents_of_memories(m)}, Workspace(spark, "t1"), **kw)
    return sorted(tuple(x) for x in out.collect())


def test_reasons(spark):
    day = timedelta(days=1)
    nodes = [
        ("a", None, T0, 1, "x"), (" a ", None, T0 - day, 1, None), ("b", '{"removed_at": "2025-03-05T00:00:00Z"}', T0, None, None), ("c", '{"removed_at": 1741132800}', T0, None, None),
        ("d", '{"removed_at": "2025-03-05 00:00:00"}', T0, None, None), ("e", "{broken", T0 + 30 * day, None, None), (None, None, T0, None, None), ("f", None, None, None, None),
    ]
    edges = [
        ("1", "a", "A", T0, None), ("2", " a", "\tb ", T0 + 4 * day, None), ("3", "b", "c", T0 + 3 * day, None), ("4", "d", "e", T0 + 5 * day, None), ("5", None, "  ", T0, None),
        ("6", "gone", "e", None, None), ("6", "gone", "e", None, None), ("7", "f", "a", T0 - 9 * day, None),
    ]
    memories = [("m", 1, None, T0), ("n", 1, T0 + day, T0), ("o", 0, T0, T0), ("p", None, None, None)]
    relations = [("r1", "m", T0), ("r2", "n", T0), ("r3", "n", T0 + day), ("r4", "o", T0 - day), ("r5", "p", T0), ("r6", "q", None)]
    assert found(spark, nodes, edges, memories, relations) == [
        ("edges", "source_id", "4", "2025-03", "deleted"), ("edges", "source_id", "6", "unknown", "missing"), ("edges", "target_id", "1", "2025-03", "missing"),
        ("edges", "target_id", "2", "2025-03", "deleted"), ("edges", "target_id", "4", "2025-03", "late"), ("edges", "target_id", "7", "2025-02", "late"),
        ("memory_edges", "target_id", "r1", "2025-03", "deleted"), ("memory_edges", "target_id", "r3", "2025-03", "deleted"), ("memory_edges", "target_id", "r4", "2025-02", "late"),
        ("memory_edges", "target_id", "r6", "unknown", "missing"),
    ]


def test_empty_tables(spark):
    assert found(spark, [], []) == []
    assert found(spark, [], [("1", "a", "b", T0, None)]) == [("edges", "source_id", "1", "2025-03", "missing"), ("edges", "target_id", "1", "2025-03", "missing")]
    assert found(spark, [("a", None, T0, 1, None)], []) == []


def test_hot_key_in_blocks(spark):
    nodes = [(f"n{i}", None, T0, None, None) for i in range(50)]
    edges = [(str(i), "n7" if i % 2 else f"n{i % 60}", "n7", T0, None) for i in range(400)]
    want = sorted(("edges", "source_id", str(i), "2025-03", "missing") for i in range(0, 400, 2) if i % 60 >= 50)
    assert found(spark, nodes, edges, range_rows=5, block_rows=16) == want


def test_equal_hashes_are_told_apart():
    import pyarrow as pa

    parents = pa.table({"_h": pa.array([5, 5, 9]), "key": ["x", "y", "z"], "early": pa.array([0, 0, 0]), "gone": pa.array([2**63 - 1] * 3)})
    refs = pa.table({"_h": pa.array([5, 5, 5, 9, 1]), "key": ["y", "x", "w", "z", "q"], "created": pa.array([1] * 5), "table_name": ["t"] * 5, "field": ["f"] * 5, "record_id": list("abcde"), "period": ["p"] * 5})
    assert O._probe(refs, parents).column("record_id").to_pylist() == ["c", "e"]
