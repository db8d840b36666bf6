"""Filling fixed-capacity containers with items (problem 8).

What fits where only depends on the items' sizes, and there are no more sizes than the capacity. So the
containers are planned on the count of items of each size: fill a container greedily with the largest size
that fits, then replace its smallest item by the two unpacked sizes that fit the widened gap more tightly, and
repeat the filling found as often as the counts allow. Every item then finds its container by its rank among
the items of its size. The plan's rows don't grow with the items.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardflow.functions.runtime import materialize


class _Stock:
    """Counts of unpacked items by size, with the largest size at or below any bound."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.n = np.zeros(capacity + 1, np.int64)
        for size, k in counts.items():
            self.n[size] = k
        self.sizes = np.flatnonzero(self.n)

    def largest(self, bound: int, taken: Counter) -> int:
        """The largest size <= bound with an item left beside those taken; 0 if none."""
        i = int(np.searchsorted(self.sizes, bound, "right")) - 1
        while i >= 0:
            size = int(self.sizes[i])
            if self.n[size] > taken[size]:
                return size
            i -= 1
        return 0

    def best_two(self, bound: int, least: int, taken: Counter) -> tuple[int, int] | None:
        """Two unpacked sizes of the largest sum <= bound that is above ``least``."""
        left = self.n[self.sizes].copy()
        for size, k in taken.items():
            left[np.searchsorted(self.sizes, size)] -= k
        have = self.sizes[left > 0]
        have = have[have < bound]
        if not len(have):
            return None
        at = np.searchsorted(have, bound - have, "right") - 1
        single = np.zeros(self.n.size, bool)
        single[self.sizes[left == 1]] = True
        partner = np.where(at >= 0, have[np.maximum(at, 0)], 0)
        clash = (partner == have) & single[have]  # the same last item twice
        partner = np.where(clash, np.where(at >= 1, have[np.maximum(at - 1, 0)], 0), partner)
        total = np.where(partner > 0, have + partner, 0)
        best = int(np.argmax(total))
        return (int(have[best]), int(partner[best])) if total[best] > least else None

    def take(self, filling: Counter, times: int) -> None:
        for size, k in filling.items():
            self.n[size] -= k * times
        self.sizes = self.sizes[self.n[self.sizes] > 0]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """(filling, how many containers are filled so), for items of sizes 1 to ``capacity``."""
    stock, out = _Stock(counts, capacity), []
    while len(stock.sizes):
        filling: Counter = Counter()
        gap = capacity
        while size := stock.largest(gap, filling):
            # As many of this size at once as fit and are left.
            k = int(min(gap // size, stock.n[size] - filling[size]))
            filling[size] += k
            gap -= k * size
        while gap:
            small = min(filling)
            rest = filling.copy()
            rest[small] -= 1
            two = stock.best_two(gap + small, small, filling)
            if two is None:
                break
            filling = +rest
            filling.update(two)
            gap = capacity - sum(s * k for s, k in filling.items())
        times = int(min(stock.n[s] // k for s, k in filling.items()))
        out.append((filling, times))
        stock.take(filling, times)
    return out


def _slots(plans: list[tuple[Counter, int]], first: int) -> dict[int, list[tuple[int, int, int]]]:
    """Of each size its runs, in order: (first rank, first container, items of the size in each container)."""
    used: Counter = Counter()
    out: dict[int, list[tuple[int, int, int]]] = {}
    container = first
    for filling, times in plans:
        for size, k in filling.items():
            out.setdefault(size, []).append((used[size], container, k))
            used[size] += k * times
        container += times
    return out


def _ranked(items: DataFrame, groups: dict[int, int]) -> DataFrame:
    """``items`` with ``rank``, counting from 0 among the items of equal ``size``.

    A size may hold a third of all items: ranks are counted within (size, hash group) and moved by how many
    items the size's earlier groups hold. ``groups``: of each size how many, so that no group has many items.
    """
    spark = items.sparkSession
    sizes = spark.createDataFrame(list(groups.items()), "size int, n_groups long")  # at most capacity rows
    grouped = items.join(F.broadcast(sizes), "size").withColumn("g", F.pmod(F.xxhash64("id", "piece"), F.col("n_groups"))).drop("n_groups")
    sums = grouped.groupBy("size", "g").agg(F.count(F.lit(1)).alias("n"))
    start = F.sum("n").over(Window.partitionBy("size").orderBy("g")) - F.col("n")
    starts = sums.select("size", "g", start.alias("start"))
    within = F.row_number().over(Window.partitionBy("size", "g").orderBy("id", "piece")) - 1
    ranked = grouped.withColumn("r", within).join(starts, ["size", "g"])
    return ranked.select("id", "piece", "start_token", "size", (F.col("start") + F.col("r")).alias("rank"))


def _containers(slots: Broadcast):
    """For mapInArrow over (id, piece, start_token, size, rank): the container of each item, its run found by halving among those of its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = {size: np.array(x, np.int64) for size, x in slots.value.items()}
        for batch in batches:
            size, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
            container = np.empty(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(size) else []:
                first, begins, each = runs[int(size[at[0]])].T
                i = np.searchsorted(first, rank[at], "right") - 1
                container[at] = begins[i] + (rank[at] - first[i]) // each[i]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(container)], names=["id", "piece", "start_token", "n_tokens", "container"])

    return run


def pack(sizes: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", capacity: int = 2048, group_rows: int = 100_000) -> DataFrame:
    """(id_col, piece, start_token, n_tokens, container): where each item, or piece of one, goes.

    Only an item above ``capacity`` is split, into pieces of exactly ``capacity``, each filling a container,
    and a rest that is packed like any item. Items of null or no size go nowhere. Containers count from 0
    without gaps and never hold more than ``capacity``; the plan is the same for any order of the input. A task ranks groups of
    about ``group_rows`` items. The plan that is broadcast has a row for each size of each filling: with every filling at least one
    size runs out or is left with too few for another, so it is bounded by the capacity, whatever the number of items.
    """
    spark = sizes.sparkSession
    items = sizes.select(F.col(id_col).alias("id"), F.col(size_col).cast("long").alias("size")).filter("size > 0")
    parts = items.select("id", "size", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("size") / capacity) - 1).cast("int"))).alias("piece"))
    parts = parts.withColumn("start_token", F.col("piece") * F.lit(capacity).cast("long"))
    parts = parts.withColumn("size", F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("start_token")).cast("int"))
    parts = materialize(parts, "parts")
    counts = {r["size"]: r["n"] for r in parts.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    slots = spark.sparkContext.broadcast(_slots(plan(counts, capacity), 0))
    ranked = _ranked(parts, {size: 1 + n // group_rows for size, n in counts.items()})
    id_type = sizes.schema[id_col].dataType.simpleString()
    placed = ranked.mapInArrow(_containers(slots), f"id {id_type}, piece int, start_token long, n_tokens int, container long")
    return placed.withColumnRenamed("id", id_col)
