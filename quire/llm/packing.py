"""Filling containers of fixed capacity by sum-of-squares packing.

Each item goes where the sum over all gaps g of N(g)^2 becomes smallest, N(g)
being the number of open containers with g left; full containers leave the sum,
and opening a container is one of the choices. The rule needs only the counters,
capacity + 1 numbers, so an item costs one pass over the gaps in use.

Items are spread evenly over partitions by a hash of their key and packed there,
longer ones first, which leaves the short ones to fill the gaps. Containers that
are not full enough at the end of a partition are emptied and their items packed
again together with those of other partitions, over fewer partitions each round,
so at any size only a handful of containers stay poorly filled. An item longer
than the capacity is cut into full containers and a rest; no other is split.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.runtime import cut

#: Items packed in one task, about; the number of partitions follows the number of items.
ITEMS_PER_TASK = 50_000
#: A container with at least this share of its capacity in use is kept as packed.
GOOD_FILL = 0.995


class SumOfSquares:
    """Sum-of-squares packing of items in order; containers are numbered from 0."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.n = np.zeros(capacity + 1, dtype=np.int64)
        self.open: dict[int, list[int]] = defaultdict(list)
        self.gaps = 0
        self.used: list[int] = []

    def place(self, size: int) -> int:
        """Container of the item."""
        if size == 0:
            if not self.used:
                self._open(0)
            return 0
        n, c = self.n, self.capacity
        # change of the sum if the item goes into a container with gap g: N(g) loses one, N(g - size) gains one
        g = np.nonzero(n[size:])[0] + size
        best, cost = -1, 0
        if len(g):
            change = 2 - 2 * n[g] + 2 * n[g - size]
            change[g == size] = 1 - 2 * n[size]
            i = int(change.argmin())
            best, cost = int(g[i]), int(change[i])
        fresh = 2 * int(n[c - size]) + 1 if size < c else 0
        if best < 0 or fresh < cost:
            return self._open(size)
        at = self.open[best].pop()
        n[best] -= 1
        self.used[at] += size
        if best > size:
            n[best - size] += 1
            self.open[best - size].append(at)
        return at

    def _open(self, size: int) -> int:
        at = len(self.used)
        self.used.append(size)
        if size < self.capacity:
            self.n[self.capacity - size] += 1
            self.open[self.capacity - size].append(at)
        return at


def pack_sizes(sizes: list[int], capacity: int) -> list[int]:
    """Container number of each size, placed in descending order."""
    packer, out = SumOfSquares(capacity), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        out[i] = packer.place(sizes[i])
    return out


def _packed(capacity: int, level: int, last: bool, good: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        p = pd.concat(parts, ignore_index=True)
        if not len(p):
            return
        p = p.sort_values(["size", "item_key", "piece"], ascending=[False, True, True], ignore_index=True)
        packer = SumOfSquares(capacity)
        p["no"] = [packer.place(int(s)) for s in p["size"]]
        fill = np.array(packer.used)[p["no"]]
        p["settled"] = last | (fill >= good * capacity)
        p["container"] = [f"{level}-{t}-{n}" for t, n in zip(p["task"], p["no"])]
        yield p[["item_key", "piece", "start", "size", "container", "settled"]]

    return run


def pack(
    items: DataFrame, size: Column, key: str, capacity: int = 2048, items_per_task: int = ITEMS_PER_TASK, good_fill: float = GOOD_FILL
) -> DataFrame:
    """item key, piece, start, size, container for every piece of every item.

    piece counts the pieces of an item from 0 and start is the piece's offset in
    it; an item is in one piece unless its size exceeds the capacity. Items of size
    0, null or less take no room and lie in some container. Repeated keys
    are items of their own. container is a string, unique over the result; an
    empty table gives an empty result. Other columns are not looked at.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    n = F.greatest(F.coalesce(size.cast("int"), F.lit(0)), F.lit(0))
    sized = items.select(F.col(key).cast("string").alias("item_key"), n.alias("_n"))
    cutting = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_n") / capacity).cast("int") - 1, F.lit(0)))
    rows = cut(
        sized.select("item_key", "_n", F.explode(cutting).alias("piece"))
        .withColumn("start", F.col("piece") * capacity)
        .select("item_key", "piece", "start", F.least(F.col("_n") - F.col("start"), F.lit(capacity)).alias("size"))
    )
    done = rows.where(F.col("size") == capacity).select("item_key", "piece", "start", "size", F.concat_ws("-", F.lit("full"), F.monotonically_increasing_id()).alias("container"))
    todo = rows.where(F.col("size") < capacity)
    schema = "item_key string, piece int, start int, size int, container string, settled boolean"
    level, before = 0, None
    while True:
        left = todo.count()
        tasks = max(1, -(-left // items_per_task))
        last = tasks == 1 or before is not None and left > 0.9 * before
        spread = todo.withColumn("task", F.pmod(F.xxhash64("item_key", "piece", F.lit(level)), F.lit(tasks)).cast("int"))
        packed = cut(spread.groupBy("task").applyInPandas(_grouped(capacity, level, last, good_fill), schema))
        done = done.unionByName(packed.where("settled").drop("settled"))
        if last:
            break
        todo, before, level = packed.where("not settled").select("item_key", "piece", "start", "size"), left, level + 1
    return done.withColumnRenamed("item_key", key)


def _grouped(capacity: int, level: int, last: bool, good: float):
    run = _packed(capacity, level, last, good)

    def one(p: pd.DataFrame) -> pd.DataFrame:
        return next(run(iter([p])))

    return one


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """containers, used, room and the share of room that is unused."""
    per = packed.groupBy("container").agg(F.sum("size").alias("used"))
    return per.agg(
        F.count("*").alias("containers"),
        F.coalesce(F.sum("used"), F.lit(0)).alias("used"),
        (F.count("*") * capacity).alias("room"),
        F.round(1 - F.sum("used") / (F.count("*") * capacity), 6).alias("unused_share"),
    )
