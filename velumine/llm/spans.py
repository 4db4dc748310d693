"""Long exact spans shared between records (problem 10), by relative Lempel-Ziv parsing.

Contents form reference blocks of bounded size, each with an index of k-grams: those that winnowing selects (the least hash of
a window of ``W`` k-grams), since every shared span of at least ``K + W - 1`` characters holds one that both texts select, at
the same place in the span. A text is factored against every block that indexes one of its k-grams; against the others no
factor can be long, so they are not visited. The parse goes over the text from left to right: at a place that the block
indexes it takes the longest factor of each reference, checks it to the left beyond its boundary, so that factors end where
the texts part, and goes on behind it for that reference and alignment. A parse that kept the longest factor of the whole
block only would lose the other references. Factors of the least length and more are shared spans.

What part of a record is shared (``spans``, ``share``) needs no pairs: the contexts of an indexed k-gram are compared by all
their windows of the least length at once, and a window of it that more than one content holds is shared by all of them.

Texts that are equal as a whole count once in the search, by their 64-bit hash, and are told apart again in the results.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velumine.session import Workspace, spread

#: Least length of a shared span in code points; K + W - 1 = LEAST.
LEAST, K = 150, 48
#: Contents that may be paired by one anchor; those of a more common one are told apart by longer windows first.
HOT = 256
#: Characters of a reference block, and texts parsed against a block in one task.
BLOCK_CHARS, VISITS = 4_000_000, 2_000
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_SLICE = 1 << 18  # characters hashed at once, so that the arrays stay in the cache


def _power(base: int, n: int) -> np.uint64:
    return np.uint64(pow(base, n, 1 << 64))


def kgram_hashes(codes: np.ndarray, k: int = K) -> np.ndarray:
    """Polynomial hashes of all k-grams by doubling; the last k - 1 places are void."""
    base = 0x9E3779B97F4A7C15
    n = len(codes)
    out = np.full(n, _NONE, dtype=np.uint64)
    if n < k:
        return out
    power, length, total, done = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), 1, None, 0
    bits = k
    while bits:
        if bits & 1:
            part = power[done : done + n - k + 1]
            total = part.copy() if total is None else total + part * _power(base, done)
            done += length
        bits >>= 1
        if bits:
            power = power[: len(power) - length] + power[length:] * _power(base, length)
            length *= 2
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(32)
    np.minimum(total, _NONE - np.uint64(1), out=total)
    out[: n - k + 1] = total
    return out


def _slide(x: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """op over x[i : i + w] for every i with a whole window."""
    length = 1
    while length * 2 <= w:
        x = op(x[:-length], x[length:])
        length *= 2
    return op(x[: len(x) - (w - length)], x[w - length :]) if w > length else x


def select_anchors(hashes: np.ndarray, w: int) -> np.ndarray:
    """Places whose hash is the least of some window of w places."""
    if len(hashes) < w:
        return np.zeros(0, dtype=np.int64)
    low = _slide(hashes, w, np.minimum)
    pad = np.zeros(w - 1, dtype=np.uint64)
    kept = _slide(np.concatenate([pad, low, pad]), w, np.maximum)
    return np.flatnonzero((kept == hashes) & (hashes != _NONE))


def anchors_of(texts: list[str], k: int = K, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, place in code points, hash) of the anchors of each text.

    In runs of one k-gram that overlaps itself, as in long rules or blanks, the first and last place and one in every
    ``least - k`` stand for the run: matches from those cover it.
    """
    w = least - k + 1
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    group: list[int] = []
    total = 0

    def flush() -> None:
        lens = np.array([len(texts[i]) for i in group], dtype=np.int64)
        codes = np.frombuffer("".join(texts[i] for i in group).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = np.cumsum(lens)
        hashes = kgram_hashes(codes, k)
        hashes[np.repeat(ends, lens) - np.arange(len(codes)) < k] = _NONE  # across two texts
        at = select_anchors(hashes, w)
        doc = np.searchsorted(ends, at, side="right")
        h = hashes[at]
        same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]) & (at[1:] - at[:-1] <= k)
        begins = np.maximum.accumulate(np.where(np.r_[True, ~same], np.arange(len(at)), 0)) if len(at) else at
        block = (at - at[begins]) // (least - k) if len(at) else at
        keep = np.ones(len(at), dtype=bool)
        keep[1:-1] = ~(same[1:] & same[:-1]) | (block[1:-1] != block[:-2])
        found.append((np.asarray(group, dtype=np.int64)[doc[keep]], at[keep] - (ends - lens)[doc[keep]], h[keep]))

    for i, t in enumerate(texts):
        if len(t) < least:
            continue
        group.append(i)
        total += len(t)
        if total >= _SLICE:
            flush()
            group, total = [], 0
    if group:
        flush()
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))  # type: ignore[return-value]


def _right(a: str, b: str, i: int, j: int) -> int:
    """Length of the common prefix of a[i:] and b[j:]."""
    n, most, step = 0, min(len(a) - i, len(b) - j), 64
    while n < most:
        step = min(step, most - n)
        if a[i + n : i + n + step] == b[j + n : j + n + step]:
            n += step
            step *= 2
        elif step == 1:
            break
        else:
            step = max(1, step // 2)
            most = min(most, n + step * 2)
    return n


def _left(a: str, b: str, i: int, j: int) -> int:
    """Length of the common suffix of a[:i] and b[:j]."""
    n, most = 0, min(i, j)
    while n < most and a[i - n - 1] == b[j - n - 1]:
        n += 1
    return n


class Block:
    """Reference texts with an index of their k-grams."""

    def __init__(self, texts: list[str], anchors: list[list[tuple[int, int]]]) -> None:
        """``anchors`` has (hash, place) of the indexed k-grams of each text."""
        self.texts = texts
        rows = sorted((h, r, at) for r, found in enumerate(anchors) for h, at in found)
        self.hashes = np.array([h for h, _, _ in rows], dtype=np.int64)
        self.places = [(r, at) for _, r, at in rows]

    def factors(self, text: str, anchors: list[tuple[int, int]], least: int = LEAST, among: set[int] | None = None) -> list[tuple[int, int, int, int]]:
        """(reference, start in text, start in reference, length) of the factors of at least ``least`` characters.

        A hash that stands for two k-grams gives a short factor, which is dropped.
        """
        out: list[tuple[int, int, int, int]] = []
        parsed: dict[tuple[int, int], int] = {}  # end of the last factor by reference and alignment
        anchors = sorted(anchors, key=lambda x: x[1])
        asked = np.array([h for h, _ in anchors], dtype=np.int64)
        first, last = np.searchsorted(self.hashes, asked, side="left"), np.searchsorted(self.hashes, asked, side="right")
        for k in np.flatnonzero(last > first).tolist():
            i = anchors[k][1]
            for r, j in self.places[first[k] : last[k]]:
                if among is not None and r not in among or i < parsed.get((r, i - j), 0):
                    continue
                right = _right(text, self.texts[r], i, j)
                parsed[r, i - j] = i + max(right, 1)
                left = _left(text, self.texts[r], i, j)
                if left + right >= least:
                    out.append((r, i - left, j - left, left + right))
        return out


def common_windows(cids: np.ndarray, starts: np.ndarray, contexts: list[str], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(content, start, end) of the regions of ``contexts`` made of windows of ``least`` characters that more than one
    content holds. ``starts`` are the contexts' places in their contents."""
    lens = np.array([len(x) for x in contexts], dtype=np.int64)
    codes = np.frombuffer("".join(contexts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(codes):
        return []
    ends = np.cumsum(lens)
    row = np.repeat(np.arange(len(contexts)), lens)
    at = np.arange(len(codes))
    at = at[ends[row] - at >= least]
    hashes = kgram_hashes(codes, least)[at]
    order = np.lexsort((cids[row[at]], hashes))
    at, hashes = at[order], hashes[order]
    new = np.r_[True, hashes[1:] != hashes[:-1]] if len(at) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    first = at[new]
    # Equal hashes of different windows do not count.
    same = np.ones(len(at), dtype=bool)
    for i in range(0, len(at), 1 << 14):
        part = slice(i, i + (1 << 14))
        span = np.arange(least)[None, :]
        same[part] = (codes[at[part, None] + span] == codes[first[group[part], None] + span]).all(1)
    at, group = at[same], group[same]
    of = cids[row[at]]
    low, high = np.full(len(first), np.iinfo(np.int64).max), np.full(len(first), np.iinfo(np.int64).min)
    np.minimum.at(low, group, of)
    np.maximum.at(high, group, of)
    hit = at[low[group] < high[group]]
    r = row[hit]
    place = starts[r] + hit - (ends[r] - lens[r])
    out: list[tuple[int, int, int]] = []
    for c, x in sorted(zip(cids[r].tolist(), place.tolist())):
        if out and out[-1][0] == c and x <= out[-1][2]:
            out[-1] = (c, out[-1][1], max(out[-1][2], x + least))
        else:
            out.append((c, x, x + least))
    return out


def _longer(reach: int):
    """Windows longer by ``reach`` on either side, with a hash of their text and of the anchor's place in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows = []
            for cid, at, s, e, text in zip(*(c.to_pylist() for c in batch.columns)):
                for lo, hi in ((s - reach, e), (s, e + reach)):
                    if lo >= 0 and hi <= len(text):
                        h = xxhash.xxh64_intdigest(text[lo:hi].encode("utf-8", "surrogatepass"), seed=at - lo)
                        rows.append((h - (1 << 64) if h >> 63 else h, cid, at, lo, hi))
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["_h", "_cid", "_at", "_s", "_e"])

    return run


class SharedSpans:
    """Shared spans of a table of texts.

    Null texts and texts below the least length share nothing. A record in several rows counts once, by its id; other
    columns are not read. Ties do not arise: every factor of sufficient length is kept.
    """

    def __init__(self, df: DataFrame, workspace: Workspace, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, k: int = K, hot: int = HOT) -> None:
        self.id_col, self.least, self.hot = id_col, least, hot
        self._texts = spread(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))).filter(F.length("_text") >= least)
        self._texts = self._texts.withColumn("_cid", F.xxhash64("_text"))
        self.work = workspace
        #: One row per record: its id, content and length.
        self.members = workspace.keep(self._texts.select("_id", "_cid", F.length("_text").alias("_len")).dropDuplicates(["_id"]))
        self._index(k)

    def _anchors(self, k: int) -> DataFrame:
        least = self.least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                doc, pos, h = anchors_of(b.column(1).to_pylist(), k, least)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column(0).take(pa.array(doc)), pa.array(pos.astype(np.int32))], names=["_h", "_cid", "_at"])

        return self._texts.select("_cid", "_text").mapInArrow(run, "_h long, _cid long, _at int")

    def _index(self, k: int) -> None:
        """``index``: (_h, _cid, _at, _s, _e, _whole) of the k-grams that several contents hold; ``parts``: every content that
        has one, with its text and its k-grams. ``_whole`` marks windows [_s, _e) of the least length.

        A k-gram in more than ``hot`` contents, as in a common heading, is not indexed as it is: a shared span reaches beyond
        it by half of what is lacking to the least length on one side at least, so it is replaced by the two windows that are
        longer by as much to the left and to the right. After a few rounds a window has the least length, and what holds it
        are results.
        """
        anchors = self.work.keep(self._anchors(k))
        shared = anchors.groupBy("_h").agg(F.min("_cid").alias("_lo"), F.max("_cid").alias("_hi")).filter("_lo < _hi").select("_h")
        # Copies of one content fall together here, before anything is compared.
        rows = self.work.keep(anchors.join(shared, "_h", "left_semi").distinct().select("_h", "_cid", "_at", F.col("_at").alias("_s"), (F.col("_at") + k).cast("int").alias("_e")))
        texts = self._texts.join(rows.select("_cid").distinct(), "_cid", "left_semi").select("_cid", "_text").dropDuplicates(["_cid"])
        texts = self.work.keep(texts)
        size, out = k, None
        while True:
            many = rows.groupBy("_h").agg(F.min("_cid").alias("_lo"), F.max("_cid").alias("_hi"), F.count_distinct("_cid").alias("_n")).filter("_lo < _hi").select("_h", "_n")
            whole = size >= self.least
            counted = rows.join(many, "_h")
            hot = None if whole else self.work.keep(many.filter(F.col("_n") > self.hot).select("_h"))
            cold = counted if whole else counted.filter(F.col("_n") <= self.hot)
            cold = cold.select("_h", "_cid", "_at", "_s", "_e", F.lit(whole).alias("_whole"))
            out = cold if out is None else out.unionByName(cold)
            if whole or hot.isEmpty():
                break
            reach = -(-(self.least - size) // 2)
            size += reach
            longer = rows.join(hot, "_h", "left_semi").join(texts, "_cid").select("_cid", "_at", "_s", "_e", "_text")
            rows = self.work.keep(longer.mapInArrow(_longer(reach), "_h long, _cid long, _at int, _s int, _e int").distinct())
        self.index = self.work.keep(out)
        own = self.index.groupBy("_cid").agg(F.collect_set(F.struct("_h", "_at")).alias("_found"))
        self.parts = self.work.keep(texts.join(own, "_cid").select("_cid", "_text", "_found"))

    def _matches(self) -> DataFrame:
        """(a, b, start in b, start in a, length) of the shared spans of each pair of different contents, a < b: each content
        is parsed against the blocks, for the references of lesser number."""
        least = self.least
        chars = self.parts.agg(F.sum(F.length("_text"))).first()[0] or 0
        blocks = max(self.work.spark.sparkContext.defaultParallelism, -(-chars // BLOCK_CHARS))
        block = F.pmod(F.xxhash64("_cid"), F.lit(blocks)).cast("int")
        held = self.index.select("_h", block.alias("_b"), "_cid").groupBy("_h", "_b").agg(F.min("_cid").alias("_least"))
        visits = self.work.keep(self.index.select("_h", "_cid").join(held, "_h").filter("_least < _cid").select("_cid", "_b").distinct())
        tasks = visits.groupBy("_b").agg(F.ceil(F.count(F.lit(1)) / VISITS).cast("int").alias("_n"))
        going = visits.join(tasks, "_b").select("_cid", "_b", F.pmod(F.xxhash64("_cid", F.lit(3)), F.col("_n")).cast("int").alias("_t")).join(self.parts, "_cid")
        names = {"_b": "_rb", "_t": "_rt", "_cid": "_rcid", "_text": "_rtext", "_found": "_rfound"}  # apart from the visitors' columns
        there = self.parts.withColumn("_b", block).join(tasks, "_b").withColumn("_t", F.explode(F.expr("sequence(0, _n - 1)")))
        there = there.select(*[F.col(c).alias(n) for c, n in names.items()])

        def parse(visitors: pa.Table, references: pa.Table) -> pa.Table:
            rows: list[tuple[int, int, int, int, int]] = []
            if len(visitors) and len(references):
                pairs = lambda column: [[(x["_h"], x["_at"]) for x in found] for found in column.to_pylist()]
                cids = references.column("_rcid").to_pylist()
                reference = Block(references.column("_rtext").to_pylist(), pairs(references.column("_rfound")))
                order = np.argsort(cids).tolist()
                ranked = [cids[k] for k in order]
                for b, text, found in zip(visitors.column("_cid").to_pylist(), visitors.column("_text").to_pylist(), pairs(visitors.column("_found"))):
                    lesser = set(order[: bisect_left(ranked, b)])
                    rows += [(cids[r], b, i, j, n) for r, i, j, n in reference.factors(text, found, least, lesser)]
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            return pa.table({name: pa.array(c, t) for name, c, t in zip(("_a", "_b", "_at_b", "_at_a", "_len"), cols, kinds)})

        left = going.select("_b", "_t", "_cid", "_text", "_found").groupBy("_b", "_t")
        right = there.groupBy("_rb", "_rt")
        return left.cogroup(right).applyInArrow(parse, "_a long, _b long, _at_b int, _at_a int, _len int")

    def _covered(self) -> DataFrame:
        """(_cid, _s, _e) of regions of contents that others hold, of at least the least length; they may overlap."""
        least = self.least
        near = self.index.filter("not _whole").select("_h", "_cid", F.greatest(F.lit(0), F.col("_e") - least).alias("_from"), (F.col("_s") + least).alias("_to"))
        contexts = near.join(self.parts.select("_cid", "_text"), "_cid").select("_h", "_cid", "_from", F.expr("substring(_text, _from + 1, _to - _from)").alias("_x"))
        rows = near.count()
        groups = max(self.work.spark.sparkContext.defaultParallelism, -(-rows // 5_000))

        def compare(t: pa.Table) -> pa.Table:
            got = common_windows(t.column("_cid").to_numpy(), t.column("_from").to_numpy(), t.column("_x").to_pylist(), least)
            cols = list(zip(*got)) if got else [[]] * 3
            return pa.table({"_cid": pa.array(cols[0], pa.int64()), "_s": pa.array(cols[1], pa.int32()), "_e": pa.array(cols[2], pa.int32())})

        found = contexts.withColumn("_g", F.pmod("_h", F.lit(groups))).groupBy("_g").applyInArrow(compare, "_cid long, _s int, _e int")
        return found.unionByName(self.index.filter("_whole").select("_cid", "_s", "_e"))

    def pairs(self, first: str = "doc_a", second: str = "doc_b") -> DataFrame:
        """Every pair of records that share a span, the smaller id first."""
        linked = self._matches().select("_a", "_b").distinct()
        of = lambda c, x: self.members.select(F.col("_cid").alias(c), F.col("_id").alias(x))
        across = linked.join(of("_a", "_x"), "_a").join(of("_b", "_y"), "_b")
        copies = of("_a", "_x").join(of("_a", "_y"), "_a").filter("_x < _y")
        both = across.select("_x", "_y").unionByName(copies.select("_x", "_y"))
        return both.select(F.least("_x", "_y").alias(first), F.greatest("_x", "_y").alias(second))

    def spans(self) -> DataFrame:
        """(id, start, end) of the maximal shared regions of each record: overlapping spans are one region."""
        from pyspark.sql import Window

        whole = self.members.groupBy("_cid").agg(F.count(F.lit(1)).alias("_n"), F.max("_len").alias("_e")).filter("_n > 1").select("_cid", F.lit(0).alias("_s"), "_e")
        every = self._covered().unionByName(whole).distinct()
        order = Window.partitionBy("_cid").orderBy("_s", "_e")
        before = F.max("_e").over(order.rowsBetween(Window.unboundedPreceding, -1))
        fresh = every.withColumn("_new", F.when(before >= F.col("_s"), 0).otherwise(1))
        regions = fresh.withColumn("_r", F.sum("_new").over(order)).groupBy("_cid", "_r").agg(F.min("_s").alias("start"), F.max("_e").alias("end"))
        return regions.join(self.members, "_cid").select(F.col("_id").alias(self.id_col), "start", "end")

    def share(self) -> DataFrame:
        """(id, n_spans, shared_chars, share) for every record that shares a span."""
        lens = self.members.select(F.col("_id").alias(self.id_col), "_len")
        found = self.spans().groupBy(self.id_col).agg(F.count(F.lit(1)).cast("int").alias("n_spans"), F.sum(F.col("end") - F.col("start")).cast("int").alias("shared_chars"))
        return found.join(lens, self.id_col).select(self.id_col, "n_spans", "shared_chars", F.round(F.col("shared_chars") / F.col("_len"), 6).alias("share"))
