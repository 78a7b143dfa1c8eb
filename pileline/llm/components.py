"""Connected components by alternating large and small stars: a distributed union-find.

Every round is two aggregations and two joins; what it leaves is checkpointed, so lineage stays short and a lost executor
costs no finished round. Joins meet a hub's links with one row, so a skewed join can split them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import cut


class Forest:
    """Union-find over the links that one task meets. What leaves it is a forest: each node with its least neighbour so far.
    It is emptied whenever it has ``most`` nodes, so its memory is bounded."""

    def __init__(self, most: int = 200_000):
        self.up: dict[int, int] = {}
        self.most = most

    def _top(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    def add(self, u: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            a, b = self._top(a), self._top(b)
            if a != b:
                self.up[max(a, b)] = min(a, b)
        if len(self.up) >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        nodes = [x for x in self.up if self._top(x) != x]
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([self._top(x) for x in nodes], pa.int64())], names=["u", "v"])
        self.up = {}


def _settled(edges: DataFrame) -> bool:
    """Whether every node points to one node only, and none to a node that points on: a star each."""
    once = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    both = once.groupBy("x").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
    return both.filter("out > 1 OR (out > 0 AND into > 0)").isEmpty()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Of links (u, v), in any direction, repeated or from a node to itself: rows (node, root), root being the least node
    that can be reached. Nodes without a link to another node have no row. An empty table gives none. A RuntimeError if
    it is not settled after ``most_rounds``; the number of rounds grows with the logarithm of the longest path."""
    u, v = F.col("u"), F.col("v")
    edges = cut(links.filter(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    for _ in range(most_rounds):
        if _settled(edges):
            return edges.select(u.alias("node"), v.alias("root"))
        both = edges.unionAll(edges.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter(v > u).select(v.alias("u"), F.col("m").alias("v")).filter(u != v).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        edges = cut(small.filter(u != v).distinct())
    raise RuntimeError(f"components: not settled after {most_rounds} rounds")


def together(trees: DataFrame, more: DataFrame) -> DataFrame:
    """Trees (node, root) after their roots were linked by the trees ``more``."""
    far = more.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
    moved = trees.join(far, F.col("root") == F.col("__n"), "left").select("node", F.coalesce("__r", "root").alias("root"))
    return moved.unionAll(more.select("node", "root"))
