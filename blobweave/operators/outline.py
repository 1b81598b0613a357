"""The outer contour of a region as a closed list of its pixels in order.

The edges between a region and what surrounds it form rings.  Walked with the region on the
right hand, an edge above a pixel leads to the right, one right of it down, one below it to
the left and one left of it up.  Neighbouring edges above the pixels of a run are taken as one stretch,
as are those below, so there are about four stretches a run.  Where a stretch ends, the 2x2
window there tells which comes next: if the pixel ahead on the left hand is of the region, that
pixel's; else, if the one ahead on the right hand is, that one's; else the next side of the same pixel, where the contour
takes no step.

Ranks along the rings are found by doubling: every stretch knows how far another one is ahead, twice as far in
each round.  First this is done within each band of rows, where stretches that
follow each other become one chain; then chains are ranked over all bands by joins, in rounds that grow with the
logarithm of the number of chains in a ring.  No task walks a region, nor holds one.

The ring starts above the first pixel (in (r, c)) of the region; rings of holes never reach it and are left
out.  A region of a single pixel has that as its only point.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .regions import PART, by_region, with_bands
from .staging import stage, unstage

KEY = ["image_id", "region_id"]
#: Sides of a pixel, in the order in which they are walked.
ABOVE, RIGHT, BELOW, LEFT = range(4)
#: The end of every outer ring.
END = -1


class _Rows:
    """Runs by row: whether a pixel is of the region, and where its run begins and ends."""

    def __init__(self, r: np.ndarray, c0: np.ndarray, c1: np.ndarray):
        self.c0, self.c1, self.low, self.stride = c0, c1, int(c0.min()) - 2, int(c1.max() - c0.min()) + 8
        self.begin = r * self.stride + (c0 - self.low)
        self.r = r

    def has(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.begin, r * self.stride + (c - self.low), "right") - 1
        return (k >= 0) & (self.r[k] == r) & (self.c1[k] >= c) & (self.c0[k] <= c)


def bare(rows: _Rows, r: np.ndarray, c0: np.ndarray, c1: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal stretches (row, first, last column) of the pixels of runs whose neighbour in row r + step is not of the region."""
    # cut the runs at the ends of those next to them
    low = np.searchsorted(rows.r * rows.stride + (rows.c1 - rows.low), (r + step) * rows.stride + (c0 - rows.low))
    high = np.searchsorted(rows.begin, (r + step) * rows.stride + (c1 - rows.low), "right")
    n = np.maximum(high - low, 0)
    run = np.repeat(np.arange(len(r)), n)
    at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    # free from the run's begin, and from behind each neighbour, to before the next one or the run's end
    owner = np.concatenate([np.arange(len(r)), run])
    first = np.concatenate([c0, rows.c1[at] + 1])
    order = np.lexsort((first, owner))
    owner, first = owner[order], first[order]
    last = c1[owner].copy()
    ends = np.full(len(owner), -1)
    ends[:-1] = np.where(owner[1:] == owner[:-1], np.arange(1, len(owner)), -1)
    begins = np.concatenate([np.full(len(r), -1), rows.c0[at]])[order]
    inner = ends >= 0
    last[inner] = begins[ends[inner]] - 1
    first = np.maximum(first, c0[owner])
    real = first <= last
    return r[owner[real]], first[real], last[real]


def _stretches(band_rows: int, width: int):
    """Kernel over a band of a region and the rows next to it: (kind, chain, a, r, c, toward, n).

    Kind 0: a stretch, which puts out the ``n`` pixels from (r, c) on in direction ``toward``; ``a`` is how many its chain puts out from
    there to its end.  Kind 1: a chain, which goes on in the one of number ``a`` and puts out ``n``.  A chain is called after its first stretch.
    """

    def kernel(band: np.ndarray, region: np.ndarray, r: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> list[tuple]:
        own = r // band_rows == band
        if not own.any():
            return []
        rows = _Rows(r, c0, c1)
        y, a, b = r[own], c0[own], c1[own]

        def number(row: np.ndarray, c: np.ndarray, side: int) -> np.ndarray:
            return (row * width + c) * 4 + side

        above, below = bare(rows, y, a, b, -1), bare(rows, y, a, b, 1)
        parts = []
        # of each side: the stretches as walked, which way that is, and which way the left hand points
        for side, (row, start, end), (dr, dc), (lr, lc) in (
            (ABOVE, above, (0, 1), (-1, 0)), (RIGHT, (y, b, b), (1, 0), (0, 1)), (BELOW, (below[0], below[2], below[1]), (0, -1), (1, 0)), (LEFT, (y, a, a), (-1, 0), (0, -1)),
        ):
            left, ahead = rows.has(row + dr + lr, end + dc + lc), rows.has(row + dr, end + dc)
            after = np.where(left, number(row + dr + lr, end + dc + lc, (side + 3) % 4), np.where(ahead, number(row + dr, end + dc, side), number(row, end, (side + 1) % 4)))
            parts.append((number(row, start, side), after, row, start, np.full(len(row), dc), np.abs(end - start) + (left | ahead)))
        name, after, row, start, toward, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(name)
        name, after, row, start, toward, n = (x[order] for x in (name, after, row, start, toward, n))
        after = np.where(after == region[0] * 4 + ABOVE, END, after)
        # how many pixels up to the last stretch before the ring's end or another band
        place = np.minimum(np.searchsorted(name, after), len(name) - 1)
        inside = name[place] == after
        jump, ahead = np.where(inside, place, np.arange(len(name))), np.where(inside, n, 0)
        for _ in range(len(name).bit_length()):
            ahead, jump = ahead + ahead[jump], jump[jump]
        ends = ~inside[jump]  # rings of holes go round for ever
        to_end = ahead + n[jump]
        first = np.ones(len(name), bool)
        first[place[inside]] = False
        first &= ends
        head = np.zeros(len(name), np.int64)
        head[jump[first]] = np.flatnonzero(first)
        chain = name[head[jump]]
        some = ends & (n > 0)
        found = [(0, *x) for x in zip(*(v[some].tolist() for v in (chain, to_end, row, start, toward, n)), strict=True)]
        return found + [(1, q, g, 0, 0, 0, t) for q, g, t in zip(name[first].tolist(), after[jump[first]].tolist(), to_end[first].tolist(), strict=True)]

    return kernel


def _ranked(chains: DataFrame) -> DataFrame:
    """(key, chain, left): how many pixels each chain (key, chain, next, left) and those after it put out; without those that never end."""
    now, before = stage(chains, "chains"), None
    while (open_ := now.where(F.col("next") != END).count()) not in (0, before):
        before, old = open_, now
        ahead = now.select(*KEY, F.col("chain").alias("next"), F.col("next").alias("_next"), F.col("left").alias("_left"))
        met = now.join(ahead, [*KEY, "next"], "left")
        # what has ended stays so; what follows no chain has ended
        now = stage(met.select(*KEY, "chain", F.coalesce("_next", F.lit(END)).alias("next"), (F.col("left") + F.coalesce("_left", F.lit(0))).alias("left")), "chains")
        unstage(old)
    return now.where(F.col("next") == END).drop("next")


def outer_contour(regions: DataFrame, width: int, band_rows: int, *, one_band: bool = False, keep: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> DataFrame:
    """(image_id, region_id, k, r, c): the points of the closed outer contour of each region from its first pixel on, clockwise on the screen.

    Points next to each other in the list, the last and the first included, are neighbours; where a region is one
    pixel wide, the contour passes a pixel more than once.  ``one_band``: no image has more rows than a band.
    ``keep`` gets the stretches, which are read twice.
    """
    found = by_region(with_bands(regions, band_rows, below=True), ["band", "region_id", "r", "c0", "c1"], _stretches(band_rows, width), "image_id long, region_id long, band long, kind int, chain long, a long, r int, c int, toward int, n long", PART)
    found = keep(found)
    chains = found.where("kind = 1").select(*KEY, "chain", F.col("a").alias("next"), F.col("n").alias("left"))
    chains = chains.where(F.col("next") == END).drop("next") if one_band else _ranked(chains)
    # the rank of a stretch: all that the ring puts out, less what is put out from there on
    first = chains.where(F.col("chain") == F.col("region_id") * 4 + ABOVE).select(*KEY, F.col("left").alias("_all"))
    own = chains.join(first, KEY).withColumnRenamed("left", "_left")
    whole = found.where("kind = 1").select(*KEY, "chain", F.col("n").alias("_whole"))
    placed = found.where("kind = 0").join(own.join(whole, [*KEY, "chain"]), [*KEY, "chain"])
    points = placed.withColumn("_k", F.col("_all") - F.col("_left") + F.col("_whole") - F.col("a")).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    points = points.select(*KEY, (F.col("_k") + F.col("_i")).alias("k"), "r", (F.col("c") + F.col("toward") * F.col("_i")).cast("int").alias("c"))
    alone = first.where("_all = 0").select(*KEY, F.lit(0).cast("long").alias("k"), F.expr(f"CAST(region_id div {width} AS INT)").alias("r"), F.expr(f"CAST(region_id % {width} AS INT)").alias("c"))
    return points.unionByName(alone)


def chain_length(points: DataFrame) -> DataFrame:
    """(image_id, region_id, contlength) of ``outer_contour``: steps along rows and columns are 1 long, diagonal ones the root of 2."""
    n = points.groupBy(*KEY).agg(F.count("*").alias("_n"))
    # each point meets the next, the last one the first
    here = points.join(n, KEY).select(*KEY, F.when(F.col("k") + 1 == F.col("_n"), F.lit(0)).otherwise(F.col("k") + 1).alias("k"), F.col("r").alias("_r"), F.col("c").alias("_c"))
    step = F.when((F.col("r") == F.col("_r")) & (F.col("c") == F.col("_c")), 0).when((F.col("r") == F.col("_r")) | (F.col("c") == F.col("_c")), 1)
    steps = here.join(points, [*KEY, "k"]).withColumn("_s", step)
    return steps.groupBy(*KEY).agg((F.sum(F.coalesce("_s", F.lit(0))) + F.sum(F.col("_s").isNull().cast("long")) * math.sqrt(2)).alias("contlength"))
