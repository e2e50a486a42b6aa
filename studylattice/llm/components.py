"""Connected components of a link table that is never collected."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studylattice.session import checkpointed


class UnionFind:
    """Disjoint sets of integers; the root of a set is its smallest member."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, node: int) -> int:
        parent = self.parent
        root = node
        while (above := parent.setdefault(root, root)) != root:
            root = above
        while parent[node] != root:
            parent[node], node = root, parent[node]
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A partition's links as one link from each node to its root within the partition."""
    sets = UnionFind()
    for batch in batches:
        for a, b in zip(batch.a.tolist(), batch.b.tolist()):
            sets.join(a, b)
    nodes = [n for n in sets.parent if sets.find(n) != n]
    for start in range(0, max(1, len(nodes)), 10_000):
        part = nodes[start : start + 10_000]
        yield pd.DataFrame({"a": part, "b": [sets.find(n) for n in part]}, dtype="int64")


def _with_lowest(links: DataFrame) -> DataFrame:
    """Links (a, b) with ``low``, the smallest of a and its neighbours."""
    lowest = links.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
    return links.join(lowest, "a")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node it reaches.

    Partitions first reduce their links to forests by union-find. Then large-star and small-star
    steps alternate until all links point to roots: each replaces a node's links by links to the
    smallest neighbour, so the table never grows. An empty table gives an empty result.
    """
    both = links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    edges = checkpointed(both.mapInPandas(_forest, "a long, b long").distinct())
    before = None
    while True:
        mirrored = edges.union(edges.select("b", "a"))
        large = _with_lowest(mirrored).filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        downward = large.filter("a <> b").distinct()
        small = _with_lowest(downward)
        edges = checkpointed(
            small.select(F.col("b").alias("a"), F.col("low").alias("b"))
            .union(small.select("a", F.col("low").alias("b")))
            .filter("a <> b")
            .distinct()
        )
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    rooted = edges.groupBy("a").agg(F.min("b").alias("component"))
    roots = rooted.select(F.col("component").alias("node")).distinct()
    return rooted.withColumnRenamed("a", "node").union(roots.select("node", F.col("node").alias("component")))
