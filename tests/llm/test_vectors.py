"""Clusters and neighbours against brute force."""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from velumine.llm import clusters as C
from velumine.llm import knn as K
from velumine.llm import vectors as V
from velumine.session import Workspace

SCHEMA = "id string, embedding array<float>, level string, _rid long, _v string"


def cloud(seed=1, blobs=5, each=60, noise=80):
    rng = np.random.default_rng(seed)
    rows = []
    for b in range(blobs):
        c = rng.normal(size=64)
        c /= np.linalg.norm(c)
        n = each if b else 3 * each
        rows += list((c + rng.normal(size=(n, 64)) * 0.045) * rng.uniform(0.5, 3, (n, 1)))
    rows += list(rng.normal(size=(noise, 64)))
    rows += [rows[0], rows[0] * 2, rows[7] + rng.normal(size=64) * 0.01 * np.linalg.norm(rows[7])]
    return [(f"v{i:04d}", [float(x) for x in r]) for i, r in enumerate(rows)]


DIRTY = [("bad1", None), ("bad2", []), ("bad3", [1.0] * 63), ("bad4", [0.0] * 64), ("bad5", [float("nan")] + [1.0] * 63), ("bad6", [float("inf")] + [1.0] * 63), ("bad7", [None] + [1.0] * 63), (None, [1.0] * 64)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "a" if not i or hash(i[-1]) % 2 else "b", 1, "clash") for i, v in rows], SCHEMA)


def unit(rows):
    x = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def components(n, linked):
    up = list(range(n))
    for i, j in linked:
        a, b = i, j
        while up[a] != a:
            a = up[a]
        while up[b] != b:
            b = up[b]
        up[max(a, b)] = min(a, b)
    out = {}
    for x in range(n):
        r = x
        while up[r] != r:
            r = up[r]
        out.setdefault(r, []).append(x)
    return list(out.values())


@pytest.mark.parametrize(("sample", "block"), [(8000, 8192), (40, 16)])
def test_vector_clusters(spark, monkeypatch, sample, block):
    monkeypatch.setattr(C, "BLOCK", block)
    rows = cloud()
    x = unit(rows)
    want = {(rows[i][0], rows[min(g)][0]) for g in components(len(rows), np.argwhere(np.triu(x @ x.T >= 0.7, 1))) if len(g) >= 10 for i in g}
    work = Workspace(spark, "t3")
    c = C.VectorClusters(V.usable(frame(spark, rows + DIRTY + rows[:5]), work, F.col("id"), "embedding"), work, sample_size=sample)
    m = c.members(10)
    assert {(r["item_id"], r["cluster_id"]) for r in m.collect()} == want
    if sample > 1000:
        top = C.describe(c.affinity(m)).collect()
        assert len(top) == len({k for _, k in want}) and all(len(r["typical"]) == 3 for r in top)


def test_no_vectors(spark):
    work = Workspace(spark, "t3")
    for rows in ([], DIRTY, cloud()[:1]):
        c = C.VectorClusters(V.usable(frame(spark, rows), work, F.col("id"), "embedding"), work)
        assert c.members(10).count() == 0


def test_word_clusters(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for k in range(30):
        base = list(rng.choice(words, 40, replace=False))
        texts.append(base)
        for _ in range(k % 4):
            copy = list(base)
            for at in rng.choice(40, int(rng.integers(0, 9)), replace=False):
                copy[at] = str(rng.choice(words))
            texts.append(copy)
    rows = [(f"c{i:03d}", " ".join(t).upper()) for i, t in enumerate(texts)]
    rows += [("dup1", rows[0][1]), ("dup2", rows[0][1] + " " + rows[0][1]), ("few", "a b c"), ("null", None), ("empty", "")]
    sets = [set(re.findall("[a-z0-9]+", (t or "").lower())) for _, t in rows]
    ok = [i for i, s in enumerate(sets) if len(s) >= 20]
    linked = [(a, b) for a, b in combinations(range(len(ok)), 2) if len(sets[ok[a]] & sets[ok[b]]) >= 0.6 * len(sets[ok[a]] | sets[ok[b]])]
    groups = [[rows[ok[x]][0] for x in g] for g in components(len(ok), linked)]
    want = {(i, min(g)) for g in groups if len(g) >= 3 for i in g}
    df = spark.createDataFrame(rows + rows[:3], "_id string, _text string")
    got = C.WordClusters(df, Workspace(spark, "t3w")).members(3)
    assert {(r["item_id"], r["cluster_id"]) for r in got.collect()} == want
    assert C.WordClusters(df.limit(0), Workspace(spark, "t3w")).members(3).count() == 0


@pytest.mark.parametrize("hot", [2048, 5])
def test_word_clusters_in_crowded_bands(spark, monkeypatch, hot):
    """Pairs among many sets that share boilerplate, which is no link, are all found."""
    monkeypatch.setattr(C, "NEAR", 1)
    monkeypatch.setattr(C, "HOT", hot, raising=False)
    rows = []
    for k in range(400):
        own = [f"p{k // 2}x{i}" for i in range(4)] + [f"o{k}x{i}" for i in range(11)] if k < 80 else [f"o{k}x{i}" for i in range(15)]
        rows.append((f"c{k:03d}", " ".join([f"base{i}" for i in range(40)] + own)))
    got = C.WordClusters(spark.createDataFrame(rows, "_id string, _text string"), Workspace(spark, "t3h")).members(2)
    assert {(r["item_id"], r["cluster_id"]) for r in got.collect()} == {(f"c{k:03d}", f"c{k // 2 * 2:03d}") for k in range(80)}


def test_components_of_a_long_chain(spark):
    """2,000 links in a chain with random labels are one component, found in a number of rounds that grows slowly."""
    order = [int(x) for x in np.random.default_rng(2).permutation(2001) + 10]
    edges = spark.createDataFrame([(0, a, b, 0.7) for a, b in zip(order, order[1:])] + [(0, 1, 2, 0.9), (1, 10, 11, 0.8)], "t int, a long, b long, w double").coalesce(2)
    work = Workspace(spark, "t3c")
    got = {(r["t"], r["node"]): r["component"] for r in C.components(edges, work).collect()}
    want = {(0, 1): 1, (0, 2): 1, (1, 10): 10, (1, 11): 10, **{(0, x): 10 for x in order}}
    assert got == want
    assert work._n < 40
    found = C.Clusters(edges, work)
    assert {(r["t"], r["node"]): r["component"] for r in found.nodes.collect()} == want
    assert {r["node"] for r in found.nodes.filter("not repaired and t = 0").collect()} == {1, 2}


def test_clusters_of_the_embedding_stand(spark):
    """Most clusters need no repair: 300 of random sizes, stars and cliques, large ones among them."""
    rng = np.random.default_rng(4)
    edges, first = [], 0
    for k in range(300):
        n = int(rng.integers(2, 40)) if k % 50 else 400
        pairs = [(i, j) for i in range(n) for j in range(i)] if k % 3 and n < 100 else [(0, j) for j in range(1, n)]
        edges += [(0, first + i, first + j, float(rng.uniform(0.6, 1))) for i, j in pairs]
        first += n
    work = Workspace(spark, "t3e")
    found = C.Clusters(spark.createDataFrame(edges, "t int, a long, b long, w double"), work)
    up = components(first, [(a, b) for _, a, b, _ in edges])
    assert {r["node"]: r["component"] for r in found.nodes.collect()} == {x: min(g) for g in up for x in g}
    counts = found.repairs().first()
    assert counts["clusters"] >= 300 and counts["failed"] <= 60


def test_records_without_a_cell(spark):
    """Small clusters that no sample shows are found by the lists' bounds."""
    rng = np.random.default_rng(6)
    rows = []
    for k in range(40):
        c = rng.normal(size=64)
        rows += [(f"s{k:02d}{i}", [float(x) for x in c + rng.normal(size=64) * 0.5]) for i in range(12)]
    x = unit(rows)
    want = {(rows[i][0], rows[min(g)][0]) for g in components(len(rows), np.argwhere(np.triu(x @ x.T >= 0.7, 1))) if len(g) >= 10 for i in g}
    work = Workspace(spark, "t3l")
    c = C.VectorClusters(V.usable(frame(spark, rows), work, F.col("id"), "embedding"), work, sample_size=30)
    assert c.n_loose > 300
    assert {(r["item_id"], r["cluster_id"]) for r in c.members(10).collect()} == want


def test_sketches_tell_chance_pairs_apart():
    rng = np.random.default_rng(3)
    base = rng.choice(1 << 30, 75, replace=False).astype(np.uint32)
    near = [np.unique(np.concatenate([base[:60], rng.choice(1 << 30, 20).astype(np.uint32)])) for _ in range(300)]  # 0.6 with each other
    far = [np.unique(rng.choice(1 << 30, 80).astype(np.uint32)) for _ in range(300)]
    agree = lambda s: C.SKETCH - np.bitwise_count(s[:1] ^ s[1:]).sum(1, dtype=np.int64)
    assert (agree(C.sketches(near)) >= C.AGREE).all() and (agree(C.sketches(far)) < C.AGREE).all()


def test_similar_sets():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 60, int(rng.integers(20, 60)))).astype(np.uint32) for _ in range(150)]
    links = [(i, j) for i, j in combinations(range(150), 2) if len(np.intersect1d(sets[i], sets[j])) >= 0.5 * len(np.union1d(sets[i], sets[j]))]
    got = C.similar_sets(sets, 0.5, pivots=4, width=16)
    assert {(min(i, j), max(i, j)) for i, j in got} <= set(links)
    assert sorted(map(sorted, components(150, got))) == sorted(map(sorted, components(150, links)))


def test_neighbours_recall_and_pairs(spark):
    rows = cloud(2)
    x = unit(rows)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    small = K.Settings(sample=300, list_rows=20, group_rows=80, part_rows=60, query_rows=100)
    deep = K.Settings(sample=200, list_rows=4, words=6, group_rows=40, part_rows=60, query_rows=100)  # three levels of lists
    for settings in (K.Settings(), small, deep):
        index = K.VectorIndex(frame(spark, rows + DIRTY + rows[:4]), Workspace(spark, "t7"), F.col("id"), "embedding", settings=settings)
        found = index.named(index.neighbours(index.rows, 10)).collect()
        got = {}
        for r in found:
            got.setdefault(r["id"], set()).add(r["neighbour_id"])
        assert set(got) == {i for i, _ in rows} and all(len(v) == 10 for v in got.values())
        hits = sum(len(got[rows[i][0]] & {rows[j][0] for j in np.argsort(-s[i])[:10]}) for i in range(len(rows)))
        assert hits / (10 * len(rows)) >= 0.9
        near = index.named(index.neighbours(index.rows, 10, floor=0.98), "a", "b").collect()
        assert {(r["a"], r["b"]) for r in near} == {(rows[i][0], rows[j][0]) for i, j in np.argwhere(s >= 0.98)}


def test_scopes_are_apart(spark):
    rows = cloud(3, 2, 30, 10)
    df = frame(spark, rows).withColumn("level", F.when(F.substring("id", 5, 1).isin("1", "3", "5"), "odd").otherwise("even"))
    index = K.VectorIndex(df, Workspace(spark, "t7"), F.col("id"), "embedding", scope=F.col("level"))
    odd = lambda i: i[4] in "135"
    assert all(odd(r["id"]) == odd(r["neighbour_id"]) for r in index.named(index.neighbours(index.rows, 5)).collect())


def test_empty_index(spark):
    for rows in ([], DIRTY, cloud()[:1]):
        index = K.VectorIndex(frame(spark, rows), Workspace(spark, "t7"), F.col("id"), "embedding")
        assert index.neighbours(index.rows, 3).count() == 0


def test_best_places():
    rng = np.random.default_rng(0)
    for n in (3, 40, 300, 5000):
        s = rng.normal(size=(7, n)).astype(np.float32)
        row, col = K.best_places(s, 20)
        for i in range(7):
            assert set(np.argsort(-s[i])[:20]) <= set(col[row == i])


def test_many_copies(spark):
    """A third of all records have one vector: nothing is lost, and no part of the search grows with them."""
    base = cloud(5, 2, 40, 10)
    rows = base + [(f"copy{i:03d}", base[3][1]) for i in range(60)]
    index = K.VectorIndex(frame(spark, rows), Workspace(spark, "t7"), F.col("id"), "embedding")
    assert index.total < len(rows) - 55
    got = {}
    for r in index.named(index.neighbours(index.rows, 10)).collect():
        got.setdefault(r["id"], []).append((r["neighbour_id"], r["similarity"]))
    x = unit(rows)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    for i, (name, _) in enumerate(rows):
        assert len({n for n, _ in got[name]}) == 10
        assert sorted(round(v, 5) for _, v in got[name]) == pytest.approx(sorted(np.sort(s[i])[-10:]), abs=2e-3)


def test_lists_grow_with_the_collection():
    """Ten times the vectors, on one sample size: ten times the lists and groups, and as many vectors in a visited group."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(200, 16))
    make = lambda n: V_unit(centres[rng.integers(0, 200, n)] + rng.normal(size=(n, 16)) * 0.4)
    seen = []
    for n in (20_000, 200_000):
        x = make(n)
        lists = K.Lists(x[:2_000], n // 50, 128, n // 500)
        at, centroid, group = lists.place(x)
        assert np.allclose(lists.centroids(at), centroid, atol=1e-5)
        row, g = lists.probe(x[:500], 16, 0.35, 48 / n)
        seen.append((math_prod(len(c) for c in lists.levels), lists.n_groups, np.bincount(group, minlength=lists.n_groups)[g].sum() / 500))
        assert (np.bincount(row, minlength=500) > 0).all()
    (l0, g0, v0), (l1, g1, v1) = seen
    assert l0 >= 400 and l1 >= 4_000 and g1 >= 4 * g0
    assert v1 < 3 * v0


def test_recall_with_production_settings(spark):
    """At least 50 lists, the settings that the queries use, against brute force."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(300, 64))
    x = (centres[rng.integers(0, 300, 16_000)] + rng.normal(size=(16_000, 64)) * 0.5).astype(np.float32)
    df = spark.createDataFrame([(f"v{i:05d}", r.tolist()) for i, r in enumerate(x)], "id string, embedding array<float>").repartition(8)
    index = K.VectorIndex(df, Workspace(spark, "t7r"), F.col("id"), "embedding")
    assert len(index.lists.levels[0]) >= 50
    asked = index.rows.filter("_id like '%00'")
    got = {}
    for r in index.named(index.neighbours(asked, 10)).collect():
        got.setdefault(r["id"], set()).add(r["neighbour_id"])
    u = V_unit(x)
    hits = 0
    for i in range(0, 16_000, 100):
        s = u @ u[i]
        s[i] = -2
        hits += len({f"v{j:05d}" for j in np.argsort(-s)[:10]} & got[f"v{i:05d}"])
    assert len(got) == 160 and hits / 1600 >= 0.9


def test_no_list_in_reach_is_left_out():
    rng = np.random.default_rng(8)
    x = V_unit(rng.normal(size=(60, 12))[rng.integers(0, 60, 4_000)] + rng.normal(size=(4_000, 12)) * 0.25)
    s = x @ x.T
    for words in (512, 16):
        lists = K.Lists(x[:1_000], 300, words, 40)
        group = lists.place(x)[2]
        row, g = lists.reach(x[:400], 0.98)
        visited = set(zip(row.tolist(), g.tolist()))
        assert all((i, int(group[j])) in visited for i, j in np.argwhere(s[:400] >= 0.98).tolist())
        assert len(visited) < 400 * lists.n_groups


def V_unit(x):
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def math_prod(values):
    out = 1
    for v in values:
        out *= v
    return out
