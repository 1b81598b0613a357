"""Ordered contours against tracing by hand."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from blobweave.operators.outline import chain_length, outer_contour
from blobweave.plans.features import Images
from blobweave.sources.rasters import mask_pixels

from .masks import text
from .test_bands import MASKS
from .test_properties import flood, moore_length


@pytest.mark.parametrize(("band_rows", "one_band"), [(100, True), (3, False), (1, False)])
def test_outer_contour(spark, band_rows, one_band):
    images = Images(mask_pixels(spark, {i: text(m) for i, m in MASKS.items()}), 50, height=40)
    points = outer_contour(images.regions, 50, band_rows, one_band=one_band).persist()
    rings = defaultdict(list)
    for r in points.collect():
        rings[r["image_id"], r["region_id"]].append((r["k"], r["r"], r["c"]))
    assert len(rings) == images.regions.select("image_id", "region_id").distinct().count()
    lengths = {(r["image_id"], r["region_id"]): r["contlength"] for r in chain_length(points).collect()}
    for (image, region), ring in rings.items():
        ring.sort()
        assert [k for k, _, _ in ring] == list(range(len(ring)))
        at = [p for _, *p in ring]
        assert at[0] == list(divmod(region, 50))
        labels = flood(MASKS[image], 2)
        mask = labels == labels[tuple(at[0])]
        assert all(mask[r, c] for r, c in at)
        steps = [math.dist(a, b) for a, b in zip(at, at[1:] + at[:1], strict=True)]
        assert len(at) == 1 or all(0 < s < 1.5 for s in steps)
        outside = flood(np.pad(~mask, 1, constant_values=True), 1)
        full = (outside != outside[0, 0])[1:-1, 1:-1]
        assert sum(steps) == pytest.approx(moore_length(full)) == pytest.approx(lengths[image, region])
        # every pixel with a neighbour outside is on it
        rim = {tuple(p - 1) for p in np.argwhere(outside != outside[0, 0]) if any(outside[tuple(p + d)] == outside[0, 0] for d in ((0, 1), (1, 0), (0, -1), (-1, 0)))}
        assert {tuple(p) for p in at} == rim
        # clockwise on the screen
        assert sum((b[1] - a[1]) * (b[0] + a[0]) for a, b in zip(at, at[1:] + at[:1], strict=True)) <= 0
    points.unpersist()
    images.release()


def test_no_regions(spark):
    images = Images(mask_pixels(spark, {1: ["#"]}).limit(0), 9)
    assert outer_contour(images.regions, 9, 2).count() == 0
    images.release()


def test_long_ring_over_many_bands(spark):
    """A comb of 300 teeth: its ring passes every band 600 times."""
    teeth = spark.range(300).select(F.lit(1).cast("long").alias("image_id"), F.explode(F.sequence(F.lit(1), F.lit(20))).alias("r"), (F.col("id") * 2).cast("int").alias("c0"), (F.col("id") * 2).cast("int").alias("c1"))
    top = spark.createDataFrame([(1, 0, 0, 598)], "image_id long, r int, c0 int, c1 int")
    runs = top.union(teeth).withColumn("run_id", F.col("r").cast("long") * 1000 + F.col("c0")).withColumn("region_id", F.lit(0).cast("long"))
    ring = outer_contour(runs, 1000, 4).orderBy("k").collect()
    assert [r["k"] for r in ring] == list(range(len(ring))) and (ring[0]["r"], ring[0]["c"]) == (0, 0)
    assert all(max(abs(a["r"] - b["r"]), abs(a["c"] - b["c"])) == 1 for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
    assert len({(r["r"], r["c"]) for r in ring}) == 599 + 6000
