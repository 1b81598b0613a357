"""The figures of ``geometry`` for regions of any size: parts by band of rows, then what the parts add up to.

No task holds a region.  What a band tells of a region is small beside its pixels: counts, the hull
of its part, the best circle and rectangle within it, the 2x2 windows on its contour.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.regions import PART, by_region, holes_of, touching, with_bands
from . import geometry as G

KEY = ["image_id", "region_id"]
_PART = "image_id long, region_id long, band long"
RUN = ["r", "c0", "c1"]


def link_counts(regions: DataFrame, band_rows: int) -> DataFrame:
    """(key, links): runs in neighbouring rows that touch."""

    def kernel(band, r, c0, c1) -> list[tuple]:
        return [(len(touching(r, c0, c1, 1)[0]),)]

    parts = by_region(with_bands(regions, band_rows), ["band", *RUN], kernel, f"{_PART}, n long", PART)
    return parts.groupBy(*KEY).agg(F.sum("n").alias("links"))


def contour_windows(regions: DataFrame, holes: DataFrame, band_rows: int) -> DataFrame:
    """(key, wr, wc, mask) of the windows that hold a step of the contour of the regions with their ``holes`` filled."""

    def kernel(band, r, c0, c1) -> list[tuple]:
        top = int(band[0]) * band_rows - 1  # windows on the row above a band are looked at with it, those on its last row with the next
        wr, wc, mask = G.windows(r, c0, c1)
        own = (wr >= top) & (wr < top + band_rows)
        return list(zip(wr[own].tolist(), wc[own].tolist(), mask[own].tolist(), strict=True))

    full = regions.select(*KEY, *RUN).unionByName(holes)
    return by_region(with_bands(full, band_rows), ["band", *RUN], kernel, f"{_PART}, wr int, wc int, mask int", PART)


def contour_lengths(windows: DataFrame) -> DataFrame:
    straight, bent, crossed = (F.sum(F.col("mask").isin(*masks).cast("long")) for masks in (G.STRAIGHT, G.BENT, G.CROSSED))
    return windows.groupBy(*KEY).agg((straight + (bent + 2 * crossed) * math.sqrt(2)).alias("contlength"))


def roundness(windows: DataFrame, regions: DataFrame) -> DataFrame:
    """distance, sigma, roundness and sides of the contour's steps, half a step at each end."""
    n = (F.col("c1") - F.col("c0") + 1).cast("decimal(20,0)")
    sums = regions.groupBy(*KEY).agg(F.sum(n).cast("double").alias("_n"), F.sum(n * F.col("r")).cast("double").alias("_r"), F.sum(n * (F.col("c0").cast("long") + F.col("c1"))).cast("double").alias("_c"))
    centres = sums.select(*KEY, (F.col("_r") / F.col("_n")).alias("_row"), (F.col("_c") / 2 / F.col("_n")).alias("_col"))
    # the ends of a window's steps; those of a crossed window count for two steps
    table = F.create_map(*[F.lit(x) for m, bits in G.STEP_ENDS.items() for x in (m, [k for k in range(4) if bits >> k & 1] * (2 if m in G.CROSSED else 1))])
    ends = windows.withColumn("_k", F.explode(table[F.col("mask")]))
    ends = ends.select(*KEY, (F.col("wr") + F.floor(F.col("_k") / 2)).alias("_y"), (F.col("wc") + F.col("_k") % 2).alias("_x")).join(centres, KEY)
    d = F.hypot(F.col("_y") - F.col("_row"), F.col("_x") - F.col("_col"))
    told = ends.groupBy(*KEY).agg(F.avg(d).alias("distance"), F.stddev_pop(d).alias("sigma"))
    told = told.withColumn("sigma", F.when(F.col("sigma") <= 1e-9 * F.col("distance"), 0.0).otherwise(F.col("sigma")))
    told = told.withColumn("roundness", F.when(F.col("distance") > 0, 1 - F.col("sigma") / F.col("distance")))
    return told.withColumn("sides", F.when(F.col("sigma") > 0, 1.4111 * F.pow(F.col("distance") / F.col("sigma"), F.lit(0.4724))))


def hull_points(regions: DataFrame, band_rows: int) -> DataFrame:
    """(key, kind, r, c): vertices of the hulls of the pixels' corners (kind 0) and centres (1) of each band of a region."""

    def kernel(r, c0, c1) -> list[tuple]:
        return [(kind, *p) for kind, find in enumerate((G.corner_hull, G.centre_hull)) for p in find(r, c0, c1).tolist()]

    return by_region(with_bands(regions, band_rows, above=False), RUN, kernel, f"{_PART}, kind int, r int, c int", PART)


def hull_figures(points: DataFrame, families: list[str]) -> DataFrame:
    """Figures of hulls, from the vertices of the hulls of a region's bands."""

    class Hulls:
        def __init__(self, kind, r, c):
            p = np.column_stack((r, c))
            self.corners, self.centres = G.hull(p[kind == 0]), G.hull(p[kind == 1])

    found = [G.FAMILIES[f][1] for f in families]

    def kernel(kind, r, c) -> list[tuple]:
        own = Hulls(kind, r, c)
        return [sum((f(own) for f in found), ())]

    return by_region(points, ["kind", "r", "c"], kernel, ", ".join(["image_id long, region_id long", *(G.FAMILIES[f][0] for f in families)]))


def seam_columns(regions: DataFrame, band_rows: int) -> DataFrame:
    """(key, band, kind, c, more): how far a region goes on from a column of the first row of a band upwards (kind 0), or of
    the last one downwards (kind 1)."""

    def kernel(band, r, c0, c1) -> list[tuple]:
        top = int(band[0]) * band_rows
        p = G.Pixels(r, c0, c1)
        first, last = p.r - p.up + 1, p.r + p.down - 1
        one = (p.r == first) & ((first == top) | (last == top + band_rows - 1))
        return list(zip(p.c[one].tolist(), first[one].tolist(), last[one].tolist(), strict=True))

    pieces = by_region(with_bands(regions, band_rows, above=False), ["band", *RUN], kernel, f"{_PART}, c int, r0 int, r1 int", PART)
    column = W.partitionBy(*KEY, "c").orderBy("r0")
    told = pieces.withColumn("_new", F.when(F.col("r0") == F.lag("r1").over(column) + 1, 0).otherwise(1)).withColumn("_g", F.sum("_new").over(column))
    whole = W.partitionBy(*KEY, "c", "_g")
    ends = told.select(*KEY, "band", "c", (F.col("r0") - F.min("r0").over(whole)).alias("_up"), (F.max("r1").over(whole) - F.col("r1")).alias("_down"))
    both = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("_up").alias("more")), F.struct(F.lit(1).alias("kind"), F.col("_down").alias("more")))).alias("_x")
    return ends.select(*KEY, "band", "c", both).select(*KEY, "band", "_x.kind", "c", "_x.more").where("more > 0")


def inscribed(regions: DataFrame, families: list[str], band_rows: int) -> DataFrame:
    """The largest circle and rectangle of each region: the best of those about, or standing on, the pixels of each band."""

    def kernel(band, kind, r, c0, c1) -> list[tuple]:
        top = int(band[0]) * band_rows
        above, below, run = (kind == k for k in range(3))
        p = G.Pixels(r[run], c0[run], c1[run], (top, top + band_rows - 1), (c0[above], c1[above]), (c0[below], c1[below]))
        out = [("inner_circle" in families and G.inner_circle(p)) or (None,) * 3, ("inner_rect" in families and G.inner_rectangle(p)) or (None,) * 5]
        return [sum(out, ())]

    runs = with_bands(regions, band_rows, above=False).select(*PART, F.lit(2).alias("kind"), *RUN)
    seams = seam_columns(regions, band_rows).select(*PART, "kind", F.lit(0).alias("r"), F.col("c").alias("c0"), F.col("more").alias("c1"))
    names = ["d2", "row", "col", "size", "r1", "k1", "r2", "k2"]
    parts = by_region(runs.unionByName(seams), ["band", "kind", *RUN], kernel, ", ".join([_PART, *(f"{n} long" for n in names)]), PART)
    circle, box = F.min(F.struct((-F.col("d2")).alias("m"), "row", "col")), F.min(F.struct((-F.col("size")).alias("m"), "r1", "k1", "r2", "k2"))
    best = parts.groupBy(*KEY).agg(circle.alias("_o"), box.alias("_b"))
    columns = []
    if "inner_circle" in families:
        columns += [F.col("_o.row").alias("inner_row"), F.col("_o.col").alias("inner_col"), (F.sqrt(-F.col("_o.m").cast("double")) - 0.5).alias("inner_radius")]
    if "inner_rect" in families:
        columns += [F.col(f"_b.{a}").alias(f"inner_{b}") for a, b in (("r1", "r1"), ("k1", "c1"), ("r2", "r2"), ("k2", "c2"))]
    return best.select(*KEY, *columns)


def geometry(regions: DataFrame, families: list[str], band_rows: int, width: int, keep: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> DataFrame:
    """As ``geometry.geometry``, without a region in one task.  ``keep`` gets what is read several times."""
    parts = []
    if holed := [f for f in families if f in ("fill", "contour", "roundness")]:
        holes = keep(holes_of(regions, band_rows, width, keep))
        if "fill" in families:
            areas = regions.select(*KEY, *RUN).unionByName(holes).groupBy(*KEY)
            parts.append(areas.agg(F.sum(F.col("c1").cast("long") - F.col("c0") + 1).alias("filled_area")))
        if holed != ["fill"]:
            windows = keep(contour_windows(regions, holes, band_rows))
            every = regions.select(*KEY).distinct()  # a single pixel has no step
            if "contour" in families:
                parts.append(every.join(contour_lengths(windows), KEY, "left").withColumn("contlength", F.coalesce("contlength", F.lit(0.0))))
            if "roundness" in families:
                parts.append(every.join(roundness(windows, regions), KEY, "left"))
    if "links" in families:
        parts.append(link_counts(regions, band_rows))
    if hulled := [f for f in families if f in ("diameter", "hull", "rect2", "circle")]:
        parts.append(hull_figures(hull_points(regions, band_rows), hulled))
    if inner := [f for f in families if f in ("inner_circle", "inner_rect")]:
        parts.append(inscribed(regions, inner, band_rows))
    joined = reduce(lambda a, b: a.join(b, KEY), parts)
    return joined.select(*KEY, *[x.split()[0] for f in families for x in G.FAMILIES[f][0].split(", ")])
