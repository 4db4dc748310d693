"""Shared spans against a comparison of all substrings."""

from __future__ import annotations

import random

from velumine.llm import spans as S
from velumine.session import Workspace

SCHEMA = "doc_id long, text string, _cid long, _h string"


def shared(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, 1, "clash") for i, t in texts], SCHEMA)
    return S.SharedSpans(df, Workspace(spark, "t10"), **kw)


def brute(texts, least):
    grams: dict[str, set[int]] = {}
    for i, t in texts:
        for k in range(len(t or "") - least + 1):
            grams.setdefault(t[k : k + least], set()).add(i)
    return {(a, b) for g in grams.values() for a in g for b in g if a < b}


def corpus(seed=3, n=40):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgéüж漢😀 ") for _ in range(rnd.randint(2, 9)))
    make = lambda chars: " ".join(word() for _ in range(chars))[:chars]
    base = [make(rnd.randint(100, 900)) for _ in range(n)]
    parts = [make(size) for size in (149, 150, 151, 200, 400)]
    out = []
    for i, t in enumerate(base):
        for p in rnd.sample(parts, 2) if i % 3 == 0 else []:
            at = rnd.randint(0, len(t))
            t = t[:at] + p + t[at:]
        out.append((i, t))
    return out + [(100, base[1]), (101, base[1]), (102, None), (103, ""), (104, "=" * 500), (105, "x" + "=" * 300), (106, "ab" * 200), (107, "zz" + "ab" * 90), (108, make(150) * 2)]


def test_pairs_against_brute_force(spark):
    texts = corpus()
    got = shared(spark, texts)
    want = brute(texts, 150)
    assert {(r["doc_a"], r["doc_b"]) for r in got.pairs().collect()} == want
    assert got.pairs().count() == len(want)


def test_common_anchors_are_told_apart(spark):
    rnd = random.Random(2)
    texts = corpus(6, 30)
    heading = "".join(rnd.choice("abcdefgh ") for _ in range(120))  # in all of them, and too short to be shared
    texts = [(i, t if not t else heading + t + heading[:149]) for i, t in texts]
    want = brute(texts, 150)
    for hot in (1, 3):
        assert {(r["doc_a"], r["doc_b"]) for r in shared(spark, texts, hot=hot).pairs().collect()} == want


def test_spans_and_share(spark):
    texts = corpus(8, 25)
    got = shared(spark, texts)
    by = dict(texts)
    want = {}
    for i, t in texts:
        mask = [False] * len(t or "")
        others = {o[k : k + 150] for j, o in texts if j != i and o for k in range(len(o) - 149)}
        for k in range(len(t or "") - 149):
            if t[k : k + 150] in others:
                mask[k : k + 150] = [True] * 150
        if any(mask):
            want[i] = sum(mask)
    assert {r["doc_id"]: r["shared_chars"] for r in got.share().collect()} == want
    for r in got.spans().collect():
        assert 0 <= r["start"] and r["end"] - r["start"] >= 150 and r["end"] <= len(by[r["doc_id"]])


def test_empty_and_short(spark):
    assert shared(spark, []).pairs().count() == 0
    assert shared(spark, [(1, "a" * 149), (2, "a" * 149), (3, None)]).pairs().count() == 0


def test_repeated_rows_count_once(spark):
    t = "".join(chr(97 + i * i % 26) for i in range(200))
    assert [tuple(r) for r in shared(spark, [(1, t), (1, t), (2, t)]).pairs().collect()] == [(1, 2)]


def test_one_doc_only_is_no_case(spark):
    rnd = random.Random(1)
    p = "".join(rnd.choice("abcdefgh") for _ in range(300))
    assert shared(spark, [(1, p + "-" + p), (2, "other" * 100)]).pairs().count() == 0


def test_factors_follow_their_alignment():
    a, b = "x" * 10 + "HELLO" * 40 + "y", "zz" + "HELLO" * 40 + "!"
    block = S.Block([b, "no" * 50], [[(7, 2), (8, 7)], [(9, 3)]])
    assert block.factors(a, [(7, 10), (8, 15), (7, 20)], 100) == [(0, 10, 2, 200), (0, 20, 2, 190)]
    assert block.factors(a, [(7, 10)], 100, among={1}) == []


def test_blocks_and_tasks_are_split(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_CHARS", 500)
    monkeypatch.setattr(S, "VISITS", 2)
    texts = corpus(5, 30)
    assert {(r["doc_a"], r["doc_b"]) for r in shared(spark, texts).pairs().collect()} == brute(texts, 150)


def test_a_passage_in_many_texts_is_shared_without_pairs(spark):
    """The rows that are compared grow with the texts that hold the passage, not with their pairs."""
    rnd = random.Random(9)
    own = lambda: "".join(rnd.choice("abcdefghijkl ") for _ in range(300))
    passage = own()
    texts = [(i, own() + passage + own()) for i in range(240)]
    rows = []
    for n in (60, 240):
        got = shared(spark, texts[:n], hot=16)
        share = got.share().collect()
        assert len(share) == n and all(0 <= r["shared_chars"] - 300 < 12 for r in share)
        rows.append(got._covered().count())
    assert rows[1] < 4.5 * rows[0]
