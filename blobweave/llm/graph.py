"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, staged


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True

    def edges(self) -> list[tuple[int, int]]:
        return [(x, self.root(x)) for x in list(self.parent) if self.root(x) != x]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars; after every few hundred thousand, so memory stays bounded."""
    def out(f: Forest) -> pa.RecordBatch:
        pairs = f.edges()
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], ["u", "v"])

    forest = Forest()
    for batch in batches:
        for a, b in zip(batch["u"].to_pylist(), batch["v"].to_pylist(), strict=True):
            forest.join(a, b)
        if len(forest.parent) > 300_000:
            yield out(forest)
            forest = Forest()
    yield out(forest)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v) that another precedes: component is the smallest node it reaches.

    Nodes that are their component's smallest, or have no edge, are left out.
    Each round hangs every node's larger neighbours on its smallest one, then its
    smaller ones; rounds grow with the logarithm of the longest path.  Sums and
    minima combine before the shuffle, and the joins are with staged tables, so
    Spark can split a hub that many nodes link to.
    """
    spark = edges.sparkSession
    now = staged(edges.where("u <> v").mapInArrow(_contract, "u long, v long").distinct(), "edges")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    state = mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = staged(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        dropped(least)
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, now = now, staged(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        dropped(old, large, least)
        before, state = state, mark(now)
        if state == before:
            return spark.createDataFrame([], "node long, component long") if not state[0] else now.select(F.col("u").alias("node"), F.col("v").alias("component"))
