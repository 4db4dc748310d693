"""Filling containers of fixed capacity (problem 9), by bin completion.

Sizes are whole numbers up to the capacity, so the items are known to the planner by their histogram alone: at most
``capacity`` counters, whatever the number of items. Bin completion branches over containers: the next one is filled around
the largest size left, with each undominated filling in turn, those of least waste first, and a filling is repeated as often
as its counts allow before fewer repetitions are tried. A branch is cut where its containers and the least number the rest
needs (``waste_bound``) reach the incumbent, which is the best-fit solution at first and then the best one found; the search
ends when the incumbent meets the bound of the whole. Where that takes more than ``NODES`` containers or fillings looked at,
the incumbent stands: that bounds the search, not the fillings that may be chosen.

The plan, a few patterns per size, is broadcast (its size does not depend on the data); items are numbered within their size
in parallel and look up the container of their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velumine.session import Workspace

#: Containers tried in a whole plan beyond the first solution, and fillings looked at for one container.
NODES, FILLINGS = 2_000, 20_000
#: Items numbered together in one window.
GROUP = 50_000


def waste_bound(left: dict[int, int], capacity: int) -> int:
    """The least number of containers that ``left`` (size: count) can need.

    For every threshold t, items above capacity - t stand alone with what is no smaller than t left out, items above half the
    capacity cannot share a container, and the others fill what room those leave at best.
    """
    if not left:
        return 0
    sizes = np.array(sorted(left), dtype=np.int64)
    n = np.array([left[s] for s in sizes.tolist()], dtype=np.int64)
    counts, sums = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(sizes * n)]
    t = np.r_[0, sizes[2 * sizes <= capacity]]
    half = int(np.searchsorted(sizes, capacity // 2 + 1))
    top = np.maximum(half, np.searchsorted(sizes, capacity - t + 1))
    low = np.minimum(half, np.searchsorted(sizes, t))
    alone, large = counts[-1] - counts[top], counts[top] - counts[half]
    room = large * capacity - (sums[top] - sums[half])
    rest = sums[half] - sums[low]
    bound = alone + large + np.maximum(0, -(-(rest - room) // capacity))
    return max(-(-int(sums[-1]) // capacity), int(bound.max()))


def least_waste(sizes: list[int], left: dict[int, int], space: int) -> list[int]:
    """Bit sets, one per position in ``sizes`` and one behind: bit r is set if items from there on can sum to exactly r."""
    mask = (1 << (space + 1)) - 1
    out = [1] * (len(sizes) + 1)
    for k in range(len(sizes) - 1, -1, -1):
        s, n, bits, step = sizes[k], min(left[sizes[k]], space // sizes[k]), out[k + 1], 1
        while n > 0:  # copies by binary splitting
            step = min(step, n)
            bits |= (bits << (s * step)) & mask
            n -= step
            step *= 2
        out[k] = bits
    return out


def _best(bits: int, room: int) -> int:
    """The greatest sum of at most ``room``."""
    return (bits & ((1 << (room + 1)) - 1)).bit_length() - 1


def dominated(chosen: tuple[int, ...], sizes: list[int], left: dict[int, int], room: int) -> bool:
    """Whether one item could take the place of one or two chosen ones within ``room`` more: the filling with it then
    dominates, since what it frees fits wherever the item would have stood (Martello and Toth)."""
    used = {c: chosen.count(c) for c in set(chosen)}
    groups = {c: c for c in used}
    groups |= {a + b: a for i, a in enumerate(chosen) for b in chosen[i + 1 :]}
    for total, least in groups.items():
        pair = total != least
        for s in range(total if pair else total + 1, total + room + 1):
            if left.get(s, 0) - used.get(s, 0) > 0:
                return True
    return False


def fillings(sizes: list[int], left: dict[int, int], space: int, most: int = FILLINGS) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of ``space`` from ``left`` (size: count), ``sizes`` its keys, falling: least waste first, and of
    equal waste those of larger items first.

    The bit sets of reachable sums say what waste can be met at all, so only branches that end in a filling of the waste
    asked for are entered. ``most`` bounds the fillings looked at.
    """
    sizes = [s for s in sizes if s <= space and left[s]]
    reach = least_waste(sizes, left, space)
    seen, goal = 0, _best(reach[0], space)
    while goal >= 0:
        stack: list[tuple[int, int, tuple[int, ...]]] = [(0, goal, ())]
        while stack:
            at, need, chosen = stack.pop()
            if not need:
                seen += 1
                if not dominated(chosen, sizes, left, space - goal):
                    yield chosen
                if seen >= most:
                    return
                continue
            if at == len(sizes) or not reach[at] >> need & 1:
                continue
            s = sizes[at]
            for n in range(0, min(left[s], need // s) + 1):  # the most copies are looked at first
                if reach[at + 1] >> (need - n * s) & 1:
                    stack.append((at + 1, need - n * s, (*chosen, *(s,) * n)))
        if not goal:
            return
        goal = _best(reach[0], goal - 1)


def _fill(left: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """The solution that takes the first filling each time, as often as its counts allow."""
    left, out = dict(left), []
    sizes = sorted(left, reverse=True)
    while sizes:
        head = sizes[0]
        left[head] -= 1
        pattern = (head, *next(fillings(sizes, left, capacity - head)))
        left[head] += 1
        times = _times(pattern, left)
        _take(left, pattern, times)
        out.append((times, pattern))
        sizes = [s for s in sizes if left[s]]
    return out


def _times(pattern: tuple[int, ...], left: dict[int, int]) -> int:
    return min(left[s] // pattern.count(s) for s in set(pattern))


def _take(left: dict[int, int], pattern: tuple[int, ...], times: int) -> None:
    for s in set(pattern):
        left[s] -= pattern.count(s) * times


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best fit, falling, over the histogram: the largest size that still fits is added until none does."""
    left, out = dict(histogram), []
    sizes = sorted(left, reverse=True)
    while sizes:
        room, pattern = capacity, []
        for s in sizes:
            n = min(left[s], room // s)
            pattern += [s] * n
            room -= n * s
        times = _times(tuple(pattern), left)
        _take(left, tuple(pattern), times)
        out.append((times, tuple(pattern)))
        sizes = [s for s in sizes if left[s]]
    return out


def plan(histogram: dict[int, int], capacity: int, nodes: int = NODES) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (times used, sizes in it) that pack every item of ``histogram`` into containers of ``capacity``."""
    left = {s: n for s, n in histogram.items() if n > 0 and 0 < s <= capacity}
    count = lambda p: sum(t for t, _ in p)
    low = waste_bound(left, capacity)
    best = min(best_fit(left, capacity), _fill(left, capacity), key=count)
    seen = 0
    # Each level of the search is one choice (filling, times) with what is left after it.
    path: list[tuple[int, tuple[int, ...]]] = []

    def choices(rest: dict[int, int]) -> Iterator[tuple[int, tuple[int, ...]]]:
        sizes = sorted((s for s in rest if rest[s]), reverse=True)
        head = sizes[0]
        rest[head] -= 1
        found = fillings(sizes, dict(rest), capacity - head)
        rest[head] += 1
        for f in found:
            pattern = (head, *f)
            for times in range(_times(pattern, rest), 0, -1):
                yield times, pattern

    stack = [choices(left)] if left and count(best) > low else []
    used = 0
    while stack and count(best) > low and seen < nodes:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if path:
                times, pattern = path.pop()
                _take(left, pattern, -times)
                used -= times
            continue
        seen += 1
        times, pattern = step
        _take(left, pattern, times)
        rest = {s: n for s, n in left.items() if n}
        if used + times + waste_bound(rest, capacity) < count(best):
            if not rest:
                best = [*path, step]
            else:
                path.append(step)
                used += times
                stack.append(choices(left))
                continue
        _take(left, pattern, -times)
    return best


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Rows (size, first rank, copies per container, first container, offset of the first copy), sorted."""
    rows, taken, base = [], {}, 0
    for times, pattern in patterns:
        offset = 0
        for s in dict.fromkeys(pattern):
            k = pattern.count(s)
            rows.append((s, taken.get(s, 0), k, base, offset))
            taken[s] = taken.get(s, 0) + k * times
            offset += k * s
        base += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(items: DataFrame, id_col: str, size_col: str, capacity: int, workspace: Workspace) -> DataFrame:
    """(id, piece, n_tokens, container, place): every item of positive size with its container and the offset in it.

    An item above the capacity is cut into full containers and a rest, numbered by ``piece``; others are never divided.
    Items of null or non-positive size have no row. ``items`` should be cheap to read; it is read three times.
    """
    spark, cap = items.sparkSession, int(capacity)
    sized = items.select(F.col(id_col), F.col(size_col).cast("long").alias("_n")).filter("_n > 0")
    pieces = sized.select(
        id_col, F.explode(F.expr(f"sequence(0L, (_n - 1) div {cap})")).alias("piece"), "_n"
    ).select(id_col, F.col("piece").cast("int").alias("piece"), F.least(F.lit(cap), F.col("_n") - F.col("piece") * cap).cast("int").alias("n_tokens"))
    histogram = {r["n_tokens"]: r["n"] for r in pieces.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    table = slots(plan(histogram, cap))
    most = max(histogram.values(), default=0)
    buckets = max(1, math.ceil(most / GROUP))
    salted = pieces.withColumn("_b", F.pmod(F.xxhash64(id_col, "piece"), F.lit(buckets)).cast("int"))
    counts = salted.groupBy("n_tokens", "_b").agg(F.count(F.lit(1)).alias("_k"))
    before = Window.partitionBy("n_tokens").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("n_tokens", "_b", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("n_tokens", "_b").orderBy(id_col, "piece")
    ranked = salted.withColumn("_r", F.row_number().over(within) - 1).join(starts, ["n_tokens", "_b"]).select(id_col, "piece", "n_tokens", (F.col("_start") + F.col("_r")).alias("_rank"))
    shared = spark.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        step = np.int64(1) << 40
        keys = t[:, 0] * step + t[:, 1]
        for b in batches:
            size, rank = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            row = t[np.searchsorted(keys, size * step + rank, side="right") - 1] if len(size) else t[:0]
            nth = rank - row[:, 1]
            container, place = row[:, 3] + nth // row[:, 2], row[:, 4] + nth % row[:, 2] * size
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(container), pa.array(place.astype(np.int32))], names=[id_col, "piece", "n_tokens", "container", "place"])

    kind = ranked.schema[id_col].dataType.simpleString()
    return ranked.mapInArrow(place, f"`{id_col}` {kind}, piece int, n_tokens int, container long, place int")
