"""Exact small cases: vectors, chunks, citations, graph, metrics, prompts, pipelines, handles, routing, readers."""

from __future__ import annotations

import io
import math
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from velumine.functions import vector as V
from velumine.operators import chunking, evaluation, graph, indexes, memory, ranking, relational, retrieval, search, state
from velumine.plans.engine import classify, hash_embedding, parse_semantic
from velumine.session import Workspace
from velumine.sources import readers


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_vector_maths(spark):
    a, b, z = V.vec([1, 2, 3]), V.vec([4, 5, 6]), V.vec([0, 0, 0])
    r = one(spark, V.norm(V.vec([3, 4])), V.dot(a, b), V.cosine(a, a), V.cosine(a, V.vec([-1, -2, -3])), V.cosine(V.vec([1, 0]), V.vec([0, 1])), V.cosine(a, z), V.euclidean(V.vec([0, 0]), V.vec([3, 4])), V.similarity_of(F.lit(1.0), "euclidean"))
    assert list(r) == pytest.approx([5, 32, 1, -1, 0, 0, 5, 0.5])
    with pytest.raises(ValueError):
        V.distance(a, b, "manhattan")


def test_binary_codes(spark):
    ones, minus = V.vec([1.0] * 40), V.vec([-1.0] * 40)
    r = one(spark, V.hamming(V.sign_words(ones, 40), V.sign_words(minus, 40)), V.hamming(V.sign_words(ones, 40), V.sign_words(ones, 40)))
    assert list(r) == [40, 0]


TEXT = "First sentence here. Second sentence follows.\n\nThird one is it. Fourth sentence ends here."


def test_offsets_in_bytes(spark):
    text = "Über sentence né. Zwei Sätze.\n\n  Dritter Absatz 😀. Ende."
    df = spark.createDataFrame([("d", text), ("e", None), ("f", "")], "doc_id string, text string")
    raw = text.encode()
    rows = chunking.hierarchy(df).collect()
    assert [r["level"] for r in rows].count("paragraph") == 2 and [r["level"] for r in rows].count("sentence") == 4
    for r in rows:
        assert raw[r["start_offset"] : r["end_offset"]].decode() == r["text"]
    ids = {r["id"] for r in rows}
    assert all(r["parent_id"] in ids or r["level"] == "document" for r in rows)
    assert f"d:p:{raw.index(b'Dritter')}" in ids


def test_whitespace_offsets(spark):
    df = spark.createDataFrame([("d", "  \n\nFirst para. \n\n Second para.")], "doc_id string, text string")
    assert [r["start_offset"] for r in chunking.hierarchy(df).filter("level = 'paragraph'").orderBy("start_offset").collect()] == [4, 19]


def test_packing_loses_nothing(spark):
    df = spark.createDataFrame([(1, TEXT.replace("\n\n", " "))], "doc_id long, text string")
    rows = chunking.packed(df, size=50).orderBy("chunk_index").collect()
    assert " ".join(r["text"] for r in rows) == TEXT.replace("\n\n", " ") and all(len(r["text"]) <= 50 for r in rows)


def test_windows_and_markdown(spark):
    df = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None)], "doc_id long, text string")
    assert [(r["start"], r["text"]) for r in chunking.windows(df, size=4, overlap=1, least=2).orderBy("start").collect()] == [(0, "abcd"), (3, "defg"), (6, "ghij")]
    md = spark.createDataFrame([(1, "intro\n# A\ntext\n## B\nmore")], "doc_id long, text string")
    assert [(r["heading_level"], r["title"], r["parent_index"]) for r in chunking.markdown(md).orderBy("chunk_index").collect()] == [(0, "", None), (1, "A", None), (2, "B", 1)]
    with pytest.raises(ValueError):
        chunking.chunk(df, "none")


def test_citation_and_highlight(spark):
    df = spark.createDataFrame([("doc1", "näive text here", 3, 8)], "d string, t string, a int, b int")
    r = df.select(retrieval.citation(F.col("d"), F.col("a"), F.col("b")).alias("c"), retrieval.highlight(F.col("t"), F.col("a"), F.col("b")).alias("h")).first()
    assert r["c"] == "[doc1:3-8]" and tuple(r["h"]) == ("nä", "ive t", "ext here")


def test_context_skips_what_does_not_fit(spark):
    texts = F.array(F.lit("aaaa"), F.lit("b" * 20), F.lit("cc"))
    assert one(spark, retrieval.assemble(texts, 7))[0] == "aaaa\n\ncc"


@pytest.fixture(scope="module")
def small_graph(spark):
    t = datetime(2025, 1, 1)
    nodes = [(i, i, "class" if i.startswith("C") else "function", "lib/a.py" if k % 2 else "src/b.py", 1, t) for k, i in enumerate(["fa", "fb", "fc", "CA", "CB", "CC"])]
    edges = [("fa", "fb", "calls", "EXTRACTED", 1.0), ("fb", "fc", "calls", "INFERRED", 1.0), ("fb", "fc", "CALLS ", "INFERRED", 1.0), ("CB", "CA", "extends", None, 1.0), ("CC", "CA", "extends", None, 1.0), ("fc", "fa", "calls", None, 1.0), (None, "fa", "calls", None, 1.0), ("fa", "gone", "calls", None, 1.0)]
    return graph.Graph(spark.createDataFrame(nodes, "id string, name string, type string, file_path string, start_line int, created_at timestamp_ntz"), spark.createDataFrame(edges, "source_id string, target_id string, type string, confidence string, weight double"))


def ids(df):
    return {r["id"] for r in df.collect()}


def test_traversal(spark, small_graph):
    at = lambda *n: spark.createDataFrame([(x,) for x in n], "id string")
    g = small_graph
    assert ids(g.callees(at("fa"), 1)) == {"fb", "gone"} and ids(g.callees(at("fa"), 2)) == {"fb", "gone", "fc"}
    assert ids(g.callers(at("fc"))) == {"fb"} and ids(g.ancestors(at("CB"))) == {"CA"} and ids(g.descendants(at("CA"))) == {"CB", "CC"}
    assert {r["path"] for r in g.callees(at("fa"), 3).collect()} == {"fa → fb", "fa → gone", "fa → fb → fc", "fa → fb → fc → fa"}
    near, inside = g.neighborhood(at("fa"), 1, Workspace(spark, "t"))
    assert ids(near) == {"fa", "fb", "fc", "gone"} and inside.count() == 4
    assert ids(g.dependents(at("fc"), Workspace(spark, "t"))) == {"fa", "fb"}
    assert ids(g.resolve("fa")) == {"fa"} and g.valid().count() == 5


def test_pagerank_sums_to_one(spark, small_graph):
    ranks = {r["id"]: r["pagerank"] for r in small_graph.pagerank(Workspace(spark, "t"), 20).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and ranks["CA"] > ranks["CB"]


def test_subgraph_writer(spark):
    n, e = "id string, v int", "source_id string, target_id string, type string"
    nodes, edges = graph.write_subgraph(spark.createDataFrame([("a", 1), ("b", 1)], n), spark.createDataFrame([("a", "b", "x")], e), spark.createDataFrame([("b", 2)], n), spark.createDataFrame([("a", "b", "x"), ("b", "a", "x"), ("b", "a", "x"), ("a", "zz", "x")], e))
    assert {tuple(r) for r in nodes.collect()} == {("a", 1), ("b", 2)} and {tuple(r) for r in edges.collect()} == {("a", "b", "x"), ("b", "a", "x")}


def test_metrics(spark):
    rows = [(["a", "b", "c", "x", "y"], ["a", "b", "c"], [1.0, 0.0, 1.0]), ([], ["a"], []), (["x"], [], [0.0]), (["x", "a"], ["a", "b", "z"], [0.0, 1.0])]
    df = evaluation.score(spark.createDataFrame(rows, "retrieved_ids array<string>, expected_ids array<string>, relevance_scores array<double>"), (2, 3, 5))
    r = df.collect()
    assert [x["precision_3"] for x in r] == [1.0, 1.0, 0.0, 0.5] and r[0]["precision_5"] == 0.6 and r[0]["recall_2"] == 0.6667
    assert [x["recall_3"] for x in r] == [1.0, 0.0, 1.0, 0.3333] and [x["mrr"] for x in r] == [1.0, 0.0, 1.0, 0.5]
    assert [x["ndcg_10"] for x in r] == [round((1 + 1 / 2) / (1 + 1 / math.log2(3)), 4), 1.0, 0.0, round(1 / math.log2(3), 4)]


def test_nearest_rank(spark):
    df = spark.createDataFrame([("k", float(v)) for v in range(1, 11)] + [("k", None)], "k string, v double")
    r = relational.nearest_rank(df, "k", "v", {"p0": 0.0, "p50": 0.5, "p100": 1.0}).first()
    assert (r["p0"], r["p50"], r["p100"]) == (1.0, 6.0, 10.0)


def test_freshness_and_text(spark):
    now = F.lit(datetime(2025, 3, 2)).cast("timestamp_ntz")
    old, none = F.lit(datetime(2025, 1, 31)).cast("timestamp_ntz"), F.lit(None).cast("timestamp_ntz")
    assert list(one(spark, ranking.freshness_score(old, now), ranking.freshness_score(none, now), ranking.text_match_score(F.lit("Some Text"), ["text", "none"]))) == [0.5, 0.5, 0.5]


def test_bloom(spark):
    df = spark.createDataFrame([("s", f"item{i}") for i in range(100)], "k string, t string")
    b = search.bloom_build(df, "k", "t")
    probes = spark.createDataFrame([(f"item{i}", True) for i in range(100)] + [(f"other{i}", False) for i in range(1000)], "t string, there boolean").crossJoin(b)
    r = probes.groupBy("there").agg(F.count_if(search.may_hold(F.col("bloom"), F.col("t"))).alias("n"))
    got = {x["there"]: x["n"] for x in r.collect()}
    assert got[True] == 100 and got[False] < 100


@pytest.mark.parametrize("name", ["exact", "binary", "quantized", "ivf", "hnsw", "pq"])
def test_indexes_find_the_planted(spark, name):
    import random

    rnd = random.Random(1)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(16)]) for i in range(60)]
    rows.append((99, [x + 0.01 for x in rows[5][1]]))
    options = {"ivf": {"n_lists": 4, "n_probe": 3}, "hnsw": {"m": 4, "part_rows": 30}, "pq": {"m": 4, "k_sub": 16}}.get(name, {})
    index = indexes.create(name, dims=16, **options).fit(spark.createDataFrame(rows, "id long, embedding array<double>"))
    assert 99 in {r["id"] for r in index.search(rows[5][1], 3).collect()}
    assert index.delete(spark.createDataFrame([(99,)], "id long")).stats().first()["vectors"] == 60 if name in ("exact", "binary") else True


def test_index_arguments():
    with pytest.raises(ValueError):
        indexes.create("pq", dims=10, m=3)
    with pytest.raises(ValueError):
        indexes.create("none")
    assert indexes.recommend(10) == "exact" and indexes.recommend(10**6, True) == "pq"


def test_cascade_of_nothing_stays_empty(spark):
    df = spark.createDataFrame([], "id long, embedding array<double>")
    assert search.cascade(df, [1.0] * 8, 3, (2, 8)).count() == 0


def test_memory(spark):
    now = datetime(2025, 2, 1)
    rows = [(f"m{i:02d}", "s", "episodic", f"note {i}", ["t"] if i % 2 else None, 0.5, i, now - timedelta(days=3, minutes=i), 0, None) for i in range(12)]
    m = spark.createDataFrame(rows, "id string, session_id string, type string, content string, tags array<string>, importance double, access_count int, created_at timestamp_ntz, forgotten int, forgotten_at timestamp_ntz")
    t = F.lit(now).cast("timestamp_ntz")
    out = {r["tag"]: r for r in memory.consolidate(m, t).collect()}
    assert out["t"]["n"] == 6 and out["general"]["summary"].split("\n")[0] == "- note 10"
    assert memory.consolidate(m.limit(5), t).count() == 0
    gone = memory.forget(m, m.filter("id = 'm01'"), t)
    assert gone.filter("forgotten = 1").count() == 1 and memory.stats(gone).first()["episodic"] == 11


def test_prompts(spark):
    p = state.Prompts(spark.createDataFrame([], "name string, version int, template string, is_active boolean"))
    p = p.store("greet", "Hi {{name}}").store("greet", "Hello {{name}}, {{other}}")
    assert p.render("greet", name="A") == "Hello A, {{other}}" and p.rollback("greet", 1).render("greet", name="A") == "Hi A"
    assert p.active().first()["versions"] == 2 and p.compare("greet", 1, 2).first()["added"] == 1
    assert p.delete("greet").active().count() == 0


def test_pipeline(spark):
    df = spark.createDataFrame([(1, 0.9, "a"), (1, 0.9, "a"), (2, 0.4, "a"), (3, 0.7, "b")], "id long, similarity double, type string").withColumn("importance", F.lit(1.0))
    p = state.Pipeline("p", [("filter", {"min_relevance": 0.5}), ("deduplicate", {}), ("rank", {}), ("sort", {})])
    assert [r["id"] for r in p.run(df).collect()] == [1, 3] and p.run(df, dry=True).count() == 4 and p.redefine(p.steps).version == 2
    with pytest.raises(ValueError):
        state.Pipeline("p", [("none", {})])


def test_handles(spark):
    h = state.Handles(spark, most=1)
    stub = h.store("res", spark.range(42).withColumnRenamed("id", "n"), ["n"])
    assert stub.startswith("res: Array(42)") and len(stub) <= 120
    assert [r["n"] for r in h.expand("res", 10, 5).collect()] == [10, 11, 12, 13, 14] and h.count("res") == 42
    h.store("other", spark.range(3), ["id"])
    assert h.names() == ["other"] and [r["name"] for r in h.search("OTH").collect()] == ["other"] and h.delete("other") and not h.delete("other")
    again = state.Handles(spark, h.root)
    again.store("late", spark.range(1), ["id"], ttl_seconds=5, created_at=datetime(2020, 1, 1))
    assert again.names() == [] and state.Handles(spark, h.root).search("late", now=datetime(2020, 1, 1)).count() == 1


def test_triggers_bound(spark):
    t = spark.createDataFrame([(i, [1.0], 0.5, True) for i in range(5)], "trigger_id long, query_vector array<double>, threshold double, active boolean")
    d = spark.createDataFrame([(1, [2.0]), (2, [-1.0])], "doc_id long, embedding array<double>")
    assert state.match_triggers(d, t).count() == 5
    with pytest.raises(ValueError):
        state.match_triggers(d, t, bound=3)


@pytest.mark.parametrize(
    ("text", "kind"),
    [("SELECT * FROM t", "simple"), ("SELECT count(*) FROM t", "simple"), ("SELECT count(*), sum(x) FROM t", "analytics"), ("SELECT a FROM t JOIN u ON x = y", "analytics"), ("SELECT rank() OVER (ORDER BY x) FROM t", "analytics"), ("SEMANTIC 'x' WHERE a > 1", "hybrid"), ("SEMANTIC 'x'", "vector"), ("SELECT a FROM t WHERE b SIMILAR TO 'x%'", "simple")],
)
def test_classify(text, kind):
    assert classify(text) == kind and classify(text, "forced") == "forced"


def test_semantic_syntax():
    assert parse_semantic("semantic 'it''s here' WHERE a > 1 LIMIT 5") == ("it's here", "a > 1", 5)
    assert parse_semantic("SELECT 1") is None and sum(x * x for x in hash_embedding("a b")) == pytest.approx(1)


def test_readers(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>A &amp; B</p><script>x</script>")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>Two </w:t><w:t xml:space='preserve'>words</w:t></w:p>")
    (tmp_path / "b.docx").write_bytes(buffer.getvalue())
    (tmp_path / "c.docx").write_bytes(b"not a zip")
    assert readers.read_html(spark, str(tmp_path / "a.html")).first()["text"] == "A & B"
    assert {r["text"] for r in readers.read_docx(spark, str(tmp_path / "*.docx")).collect()} == {"Two words", None}
    assert readers.read_text(spark, str(tmp_path / "a.html")).first()["lines"] == 1
    assert readers.read_binary(spark, str(tmp_path / "b.docx")).first()["kind"] == "file"
    s = readers.Storage(spark, f"file://{tmp_path}/store")
    s.put("x/a", str(tmp_path / "a.html"))
    s.get("x/a", str(tmp_path / "copy"))
    assert s.exists("x/a") and s.list("x") == ["a"] and s.delete("x/a") and not s.exists("x/a") and s.list("nowhere") == []


def test_shards_and_upsert(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 2) for i in range(10)], "id long, shard_id int")
    readers.write_shards(df, str(tmp_path / "t"), most_rows=3)
    back = spark.read.parquet(str(tmp_path / "t"))
    assert readers.scan_status(back).agg(F.sum("rows")).first()[0] == 10
    new = spark.createDataFrame([(3, 9), (77, 9)], "id long, shard_id int")
    assert {tuple(r) for r in readers.upsert(df, new, "id").filter("shard_id = 9").collect()} == {(3, 9), (77, 9)} and readers.upsert(df, new, "id").count() == 11


def test_partitioning_changes_nothing(spark, sf_dir):
    from velumine.sources.tables import load

    li = load(spark, sf_dir, "lineitem")
    agg = lambda d: sorted(map(tuple, d.groupBy("l_returnflag").agg(F.round(F.avg("l_quantity"), 6), F.count_distinct("l_partkey")).collect()))
    assert agg(li) == agg(li.repartition(13))
    top = lambda d: [r["l_orderkey"] for r in relational.top_per_key(d, ["l_returnflag"], [F.desc("l_extendedprice"), F.asc("l_orderkey")], 2, "l_orderkey").orderBy("l_returnflag", "l_orderkey").collect()]
    assert top(li) == top(li.repartition(7))


def test_purge(spark):
    from velumine.session import purge

    work = Workspace(spark, "old")
    kept = work.keep(spark.range(3))
    assert kept.count() == 3
    purge(spark, hours=1)
    assert kept.count() == 3
    assert purge(spark, hours=-1) >= 1


def test_asof_over_bins(spark):
    t = datetime(2025, 1, 1)
    at = lambda d, h=0: t + timedelta(days=d, hours=h)
    left = spark.createDataFrame([("k", at(0), 1), ("k", at(5), 2), ("k", at(5, 2), 3), ("x", at(1), 4)], "k string, ts timestamp_ntz, n int")
    right = spark.createDataFrame([("k", at(1), "a"), ("k", at(1, 1), None), ("k", at(5, 1), "b"), ("k", at(5, 2), "c"), ("k", at(9), "z")], "k string, ts timestamp_ntz, v string")
    got = {r["n"]: r["v"] for r in relational.asof_join(left, right, "k", "ts", ["v"]).collect()}
    assert got == {1: None, 2: None, 3: "c", 4: None}
