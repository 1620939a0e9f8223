"""Filling fixed-capacity containers by minimum bin slack on a histogram of sizes.

Items of one size are interchangeable, so containers are planned on the counts by
size, of which there are at most as many as the capacity, however many items
there are. For each container the largest item left is placed, and a bitset
subset-sum dynamic programme over the sizes available finds the fullest feasible
filling of the rest; the combination is removed as often as the counts allow. It
repeats until no item is left. Every combination exhausts a size (to less than
its multiplicity), so their number is bounded by the capacity as well.

Items then find their container by their rank among the items of their size. The
rank is counted in hashed parts with prefix sums over the part counts, so a size
shared by a third of all items is never sorted in one task.

Defined results: an item larger than the capacity is cut into pieces of exactly
the capacity, numbered from 0, and a smaller last piece; every other item is one
piece 0 and is never split. Items of size 0 or null take no space and go to
container 0. Containers are numbered from 0 within their pack, without gaps.
Repeated ids are separate items; an empty table gives an empty result; other
columns of the input are ignored. Capacities must be positive.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinspark.session import materialize

#: Parts in which the items of one size are ranked, at least, and the rows a part has on the average at most.
PARTS, ROWS_A_PART = 32, 4_000_000
#: Packs are few and of bounded capacity; the plan is held by the driver and every worker.
MAX_TOTAL_CAPACITY = 1_000_000


def fullest(counts: dict[int, int], sizes: list[int], room: int) -> list[int]:
    """Sizes from ``counts`` (at most so many of each) with the largest sum up to ``room``.

    ``sizes``: the available sizes, largest first. The bitset of sums grows size
    by size; it stops as soon as the room can be filled to the last unit.
    """
    sums, mask, target = 1, (1 << (room + 1)) - 1, 1 << room
    history: list[tuple[int, int]] = []
    for s in sizes:
        if s > room:
            continue
        for _ in range(min(counts[s], room // s)):
            grown = (sums | (sums << s)) & mask
            if grown == sums:
                break
            history.append((s, sums))
            sums = grown
        if sums & target:
            break
    best, out = sums.bit_length() - 1, []
    for s, before in reversed(history):
        if not before >> best & 1:
            out.append(s)
            best -= s
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """(combination of sizes, number of containers filled by it), in order of use."""
    counts = {s: n for s, n in histogram.items() if n > 0 and s > 0}
    order = sorted(counts, reverse=True)
    out: list[tuple[Counter, int]] = []
    while order:
        first = order[0]
        counts[first] -= 1
        combination = Counter(fullest(counts, order, capacity - first))
        counts[first] += 1
        combination[first] += 1
        times = min(counts[s] // n for s, n in combination.items())
        for s, n in combination.items():
            counts[s] -= n * times
        if any(counts[s] == 0 for s in combination):
            order = [s for s in order if counts[s]]
        out.append((combination, times))
    return out


def pieces(items: DataFrame, packs: list[tuple[str, int]], id_col: str, size_col: str) -> DataFrame:
    """(pack, id, piece, size): every item under every pack, cut where it exceeds the capacity."""
    sized = items.select(F.col(id_col).alias("id"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("total"))
    choices = F.array(*[F.struct(F.lit(i).alias("pack"), F.lit(c).cast("long").alias("capacity")) for i, (_, c) in enumerate(packs)])
    each = sized.select("id", "total", F.inline(choices))
    last = F.greatest(F.ceil(F.col("total") / F.col("capacity")) - 1, F.lit(0))
    cut = each.select("pack", "id", "total", "capacity", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("piece"))
    return cut.select("pack", "id", "piece", F.least(F.col("capacity"), F.col("total") - F.col("piece") * F.col("capacity")).alias("size"))


def _placer(keys: np.ndarray, bases: np.ndarray, repeats: np.ndarray):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pack, size, rank = (b.column(i).to_numpy() for i in (0, 3, 4))
            key = (pack.astype(np.int64) << 20 | size) << 40 | rank
            at = np.searchsorted(keys, key, side="right") - 1
            at = np.where(size > 0, at, 0)
            container = np.where(size > 0, bases[at] + (key - keys[at]) // repeats[at], 0) if len(keys) else np.zeros(len(key), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(container)], names=["pack", "id", "piece", "size", "container"])

    return place


def fill_containers(items: DataFrame, packs: list[tuple[str, int]], id_col: str, size_col: str) -> DataFrame:
    """(pack_name, id, piece, size, container) of every item, or piece of it, under every pack."""
    if sum(c for _, c in packs) > MAX_TOTAL_CAPACITY or any(c <= 0 for _, c in packs):
        raise ValueError("capacities must be positive and small enough to plan")
    parted = materialize(pieces(items, packs, id_col, size_col), "pieces")
    # one size may be that of any share of the pieces
    parts = max(PARTS, -(-parted.count() // ROWS_A_PART))
    parted = parted.withColumn("part", F.pmod(F.xxhash64("id", "piece"), F.lit(parts)))
    counted = parted.groupBy("pack", "size", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("pack", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(counted.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))), "starts")
    # at most one row for each pack and size up to its capacity
    histogram = starts.groupBy("pack", "size").agg(F.sum("n").alias("n")).collect()
    keys, bases, repeats = [], [], []
    for i, (_, capacity) in enumerate(packs):
        used, container = Counter(), 0
        for combination, times in plan({r["size"]: r["n"] for r in histogram if r["pack"] == i}, capacity):
            for s, n in combination.items():
                keys.append((i << 20 | s) << 40 | used[s])
                bases.append(container)
                repeats.append(n)
                used[s] += n * times
            container += times
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    place = _placer(*(np.array(x, np.int64)[order] for x in (keys, bases, repeats)))
    within = Window.partitionBy("pack", "size", "part").orderBy("id", "piece")
    ranked = (
        parted.withColumn("k", F.row_number().over(within) - 1)
        .join(starts.select("pack", "size", "part", "start"), ["pack", "size", "part"])
        .select("pack", "id", "piece", "size", (F.col("start") + F.col("k")).alias("rank"))
    )
    placed = ranked.mapInArrow(place, f"pack int, id {dict(ranked.dtypes)['id']}, piece long, size long, container long")
    names = F.array(*[F.lit(n) for n, _ in packs]) if packs else F.array().cast("array<string>")
    return placed.select(F.get(names, F.col("pack")).alias("pack_name"), F.col("id").alias(id_col), "piece", "size", "container")
