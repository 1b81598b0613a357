"""Labels that links join, on graphs of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage, unstage

#: Links of one graph that a task takes; of larger graphs, stars are contracted by shuffles first.
LINKS_IN_TASK = 2_000_000


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that links (a, b) reach from each of ``n`` indices.

    Each round hangs the roots of all links on the smaller one and shortens the ways; rounds grow with the logarithm of the longest way.
    """
    parent = np.arange(n)
    while len(a):
        x, y = parent[a], parent[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    return parent


def _stars(keys: list[str]):
    """Kernel: links (keys, a, b) to those of each label with the smallest that a task's links reach from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch[c].to_numpy(zero_copy_only=False) for c in keys]
            ends = [np.column_stack([*columns, batch[c].to_numpy(zero_copy_only=False)]) for c in "ab"]
            nodes, index = np.unique(np.concatenate(ends), axis=0, return_inverse=True)
            top = joined(len(nodes), *np.split(index.ravel(), 2))
            low = np.flatnonzero(top != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([*(pa.array(nodes[low, i]) for i in range(len(keys))), pa.array(nodes[low, -1]), pa.array(nodes[top[low], -1])], [*keys, "a", "b"])

    return run


def _roots(keys: list[str]):
    def run(table: pa.Table) -> pa.Table:
        ids, index = np.unique(np.concatenate([table["a"].to_numpy(), table["b"].to_numpy()]), return_inverse=True)
        top = joined(len(ids), *np.split(index, 2))
        own = {k: pa.array(np.full(len(ids), table[k][0].as_py(), np.int64)) for k in keys}
        return pa.table({**own, "label": pa.array(ids), "root": pa.array(ids[top])})

    return run


def _round(now: DataFrame, keys: list[str]) -> DataFrame:
    """Every node's larger neighbours hung on its smallest one, then its smaller ones; sums combine before the shuffle."""
    names = [*keys, "u", "v"]
    now = now.toDF(*names)
    both = now.unionByName(now.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(*keys, "u").agg(F.min("v").alias("m")).select(*keys, "u", F.least("u", "m").alias("m"))
    large = stage(both.where("v > u").join(least, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
    least = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
    small = large.join(least, [*keys, "u"]).where("v <> m").select(*keys, F.col("m").alias("u"), F.col("v"))
    out = stage(small.unionByName(least.select(*keys, "u", F.col("m").alias("v"))).distinct().toDF(*keys, "a", "b"), "links")
    unstage(large)
    return out


def roots_of(links: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, root) of every label in ``links`` (keys, a, b; all long): the smallest label of the same keys that it reaches.

    Links are contracted where they are made.  While a graph has more than LINKS_IN_TASK of them, stars are
    contracted by joins; each round leaves fewer or shorter ways, and labels stay linked.
    """
    names = ", ".join(f"{c} long" for c in [*keys, "a", "b"])
    # a link between a label and itself keeps the label in the result
    now = stage(links.select(*keys, "a", "b").where("a <> b").mapInArrow(_stars(keys), names).distinct(), "links")
    before = None
    while True:
        count, largest = now.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
        mark = (count, now.agg(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()[0])
        if not count or largest <= LINKS_IN_TASK or mark == before:
            break
        before, old = mark, now
        now = _round(now, keys)
        unstage(old)
    if count and largest > LINKS_IN_TASK:  # stars already: each link goes to its root
        return now.select(*keys, F.col("a").alias("label"), F.col("b").alias("root"))
    return now.groupBy(*keys).applyInArrow(_roots(keys), ", ".join(f"{c} long" for c in [*keys, "label", "root"]))
