"""Best-fit-decreasing bin packing of indivisible groups into fixed-capacity shards.

Groups, largest first, enter the tightest bin that still holds them, found through a balanced tree over the bins'
remaining capacity. Only the histogram of group sizes reaches the driver, at a bounded resolution; a run of equal sizes
is placed at once, since the tightest bin stays the tightest until it is full. Groups then take their run's bin by
their place in the global order of sizes, which is computed by ranges, never in one task.

Cases: a null text counts as an empty one, in size and group. Rows that repeat are shards' rows like others. Fewer
groups than shards leave shards empty. A group larger than a fair share gets a shard of its own. An empty table gives
an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagflow.llm.common import before_part, ordered, spread_join, written

#: Sizes are exact below 2**CLASS_BITS and kept to that many bits above, rounded up: at most 50 * 2**13 classes.
CLASS_BITS = 14
#: Bytes that each row costs besides its text.
ROW_BYTES = 8


class Node:
    __slots__ = ("key", "left", "level", "right")

    def __init__(self, key: tuple[int, int]):
        self.key, self.level, self.left, self.right = key, 1, None, None


class BalancedTree:
    """An AA tree of (remaining capacity, bin)."""

    def __init__(self) -> None:
        self.root: Node | None = None

    def insert(self, key: tuple[int, int]) -> None:
        self.root = self._insert(self.root, key)

    def remove(self, key: tuple[int, int]) -> None:
        self.root = self._remove(self.root, key)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The least key with at least ``size`` left."""
        node, best = self.root, None
        while node:
            if node.key >= (size, -1):
                best, node = node.key, node.left
            else:
                node = node.right
        return best

    @staticmethod
    def _level(node: Node | None) -> int:
        return node.level if node else 0

    def _skew(self, node: Node) -> Node:
        if node.left and node.left.level == node.level:
            up = node.left
            node.left, up.right = up.right, node
            return up
        return node

    def _split(self, node: Node) -> Node:
        if node.right and node.right.right and node.right.right.level == node.level:
            up = node.right
            node.right, up.left = up.left, node
            up.level += 1
            return up
        return node

    def _insert(self, node: Node | None, key: tuple[int, int]) -> Node:
        if node is None:
            return Node(key)
        if key < node.key:
            node.left = self._insert(node.left, key)
        else:
            node.right = self._insert(node.right, key)
        return self._split(self._skew(node))

    def _remove(self, node: Node | None, key: tuple[int, int]) -> Node | None:
        if node is None:
            return None
        if key < node.key:
            node.left = self._remove(node.left, key)
        elif key > node.key:
            node.right = self._remove(node.right, key)
        elif node.left is None:
            return node.right
        else:
            heir = node.left
            while heir.right:
                heir = heir.right
            node.key = heir.key
            node.left = self._remove(node.left, heir.key)
        should = min(self._level(node.left), self._level(node.right)) + 1
        if should < node.level:
            node.level = should
            if node.right and node.right.level > should:
                node.right.level = should
        node = self._skew(node)
        if node.right:
            node.right = self._skew(node.right)
            if node.right.right:
                node.right.right = self._skew(node.right.right)
        node = self._split(node)
        if node.right:
            node.right = self._split(node.right)
        return node


def best_fit(sizes: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int]] | None:
    """Runs of (bin, groups) in the order of ``sizes``, pairs of (size, groups) with the largest first; None if it takes more than ``most`` bins."""
    tree, bins, runs = BalancedTree(), 0, []
    for size, groups in sizes:
        while groups:
            if found := tree.tightest(size):
                tree.remove(found)
                left, place = found
            else:
                if bins == most:
                    return None
                left, place, bins = capacity, bins, bins + 1
            take = min(groups, max(1, left // size))
            runs.append((place, take))
            groups -= take
            tree.insert((left - take * size, place))
    return runs


def plan(sizes: list[tuple[int, int]], shards: int) -> tuple[list[tuple[int, int]], int]:
    """The runs of the smallest capacity with which best-fit-decreasing needs at most ``shards`` bins, and that capacity.

    Groups beyond a fair share of what is left get bins of their own first, so that the others still come out equal.
    """
    total, alone = sum(s * n for s, n in sizes), []
    sizes = sorted(sizes, reverse=True)
    while sizes and shards - len(alone) > 1 and sizes[0][0] * (shards - len(alone)) > total:
        (size, n), rest = sizes[0], sizes[1:]
        alone.append((len(alone), 1))
        total -= size
        sizes = [(size, n - 1), *rest] if n > 1 else rest
    if not sizes:
        return alone, 0
    free = shards - len(alone)
    low, high = max(-(-total // free), sizes[0][0]), total
    best = best_fit(sizes, low, free)
    if best is None:
        step = max(1, low >> 15)
        while (best := best_fit(sizes, low + step, free)) is None:
            step *= 2
        low, high = low + step // 2, low + step
        while high - low > max(1, low >> 16):
            mid = (low + high) // 2
            if runs := best_fit(sizes, mid, free):
                best, high = runs, mid
            else:
                low = mid
    return alone + [(b + len(alone), n) for b, n in best], high


def size_class(size: str) -> F.Column:
    """``size`` rounded up to CLASS_BITS significant bits."""
    excess = F.greatest(F.lit(0), F.length(F.bin(F.col(size))) - CLASS_BITS)
    unit = F.expr(f"shiftleft(1L, greatest(0, length(bin({size})) - {CLASS_BITS}))")
    return F.when(excess > 0, F.ceil(F.col(size) / unit) * unit).otherwise(F.col(size)).cast("long")


def shard_by_size(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, size, text_crc32, group (hash of the text), shard and slot for each row of ``docs``; rows with equal texts share a shard.

    Texts are read once; what is shuffled is a hash, a key and sizes per row. The shards' slots follow ``key``.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = written(docs.select(
        F.col(key).alias("key"), (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.sha2(body, 256).alias("group")))
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).withColumn("class", size_class("bytes")).select((-F.col("class")).alias("order"), "group", "n")
    groups, before = ordered(groups, "order", "group")
    sizes = [(-o, n) for o, n in groups.groupBy("order").count().collect()]  # bounded by CLASS_BITS
    runs, _ = plan(sizes, shards)
    ends = np.cumsum([n for _, n in runs])
    bins = np.array([b for b, _ in runs], np.int32)

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = before_part(before, b.column("_part").to_numpy()) + b.column("_row").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("group"), pa.array(bins[np.searchsorted(ends, rank, side="right")])], names=["group", "shard"])

    placed = groups.select("group", "_part", "_row").mapInArrow(to_bins, "group string, shard int")
    rows, before = ordered(spread_join(rows, placed, "group", groups.select("group", "n"), rows.count()).select("shard", "key", "text_crc32", "size", "group"), "shard", "key", "group", "size")
    counts = dict(map(tuple, rows.groupBy("shard").count().collect()))
    begin = np.zeros(max(shards, 1) + 1, np.int64)
    for s in range(shards):
        begin[s + 1] = begin[s] + counts.get(s, 0)

    def to_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = before_part(before, b.column("_part").to_numpy()) + b.column("_row").to_numpy()
            slot = rank - begin[b.column("shard").to_numpy()]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(slot)], names=[*b.schema.names[:5], "slot"])

    kind = dict(rows.dtypes)["key"]
    return rows.mapInArrow(to_slots, f"shard int, key {kind}, text_crc32 long, size long, group string, slot long").withColumnRenamed("key", key)
