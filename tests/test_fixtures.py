"""Drawn shapes against hand-checkable numbers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from blobweave.functions import geometry, shape
from blobweave.plans.features import FEATURES, Images
from blobweave.sources.rasters import mask_pixels

from .masks import DRAWN, text

#: A, L, circularity, compactness, convexity, rectangularity, Roundness, Sides, Ra, Rb, Anisometry, Bulkiness, K; computed by brute force.
EXPECTED = {
    "px1": (1, 0, None, 0, 1, 1, None, None, 0, 0, None, 0, 1),
    "sq2": (4, 4, 1, 0.3183, 1, 1, 1, None, 1, 1, 1, 0.7854, 1),
    "line1x20": (20, 38, 0.0705, 5.7455, 1, 1, 0.4227, 1.829, 11.533, 0, math.inf, 0, 0.2236),
    "sq10": (100, 36, 0.7860, 1.0313, 1, 1, 0.8852, 3.924, 5.745, 5.745, 1, 1.0367, 1),
    "rect10x40": (400, 96, 0.3179, 1.8335, 1, 1, 0.5709, 2.104, 23.087, 5.745, 4.0189, 1.0416, 0.5),
    "disc3": (29, 19.314, 1, 1.0236, 0.7838, 0.6444, 0.8662, 3.650, 3.063, 3.063, 1, 1.0161, 1.2999),
    "disc10": (317, 65.941, 1, 1.0915, 0.9188, 0.7459, 0.9642, 6.802, 10.051, 10.051, 1, 1.0012, 1.1795),
    "disc50": (7845, 329.706, 0.9989, 1.1027, 0.9820, 0.7781, 0.9941, 15.990, 49.972, 49.972, 1, 1.0000, 1.1403),
    "ring": (940, 131.882, 0.7480, 1.4724, 0.7159, 0.5701, 0.9839, 9.923, 22.384, 22.384, 1, 1.6746, 2.0222),
    "L": (175, 75.414, 0.2769, 2.5862, 0.6087, 0.4375, 0.5919, 2.155, 14.422, 7.814, 1.8456, 2.0231, 1.5119),
    "ell_semi": (12555, 481.872, 0.4008, 1.4718, 0.9840, 0.7690, 0.6995, 2.490, 99.891, 40.007, 2.4968, 1.0000, 1.0799),
    "ell_full": (3139, 239.765, 0.4039, 1.4574, 0.9697, 0.7582, 0.6968, 2.480, 50.031, 19.971, 2.5052, 1.0000, 1.0888),
}
COLUMNS = ["area", "contlength", "circularity", "compactness", "convexity", "rectangularity", "roundness", "sides", "ra", "rb", "anisometry", "bulkiness", "k_factor"]


@pytest.fixture(scope="module")
def features(spark):
    im = Images(mask_pixels(spark, {i: text(m) for i, (_, m) in DRAWN.items()}), 1000)
    return {DRAWN[r["image_id"]][0]: r for r in im.features.collect()}


def test_every_shape_is_one_region_and_none_is_empty(features):
    assert set(features) == {name for name, _ in DRAWN.values()} - {"empty"}
    assert set(FEATURES) < set(features["px1"].asDict())


@pytest.mark.parametrize("name", EXPECTED)
def test_values(features, name):
    for column, want in zip(COLUMNS, EXPECTED[name], strict=True):
        got = features[name][column]
        assert got is None if want is None else got == pytest.approx(want, rel=3e-4, abs=6e-5), column


@pytest.mark.parametrize(("name", "ra", "rb", "degrees"), [("ell_semi", 100, 40, 30), ("ell_full", 50, 20, 30), ("ell_120", 100, 40, -60)])
def test_ellipse_within_two_percent(features, name, ra, rb, degrees):
    r = features[name]
    assert r["ra"] == pytest.approx(ra, rel=0.02) and r["rb"] == pytest.approx(rb, rel=0.02)
    assert math.degrees(r["phi"]) == pytest.approx(degrees, rel=0.02)


def test_topology_and_holes(features):
    assert {n: r["area_holes"] for n, r in features.items() if r["area_holes"]} == {"ring": 317}
    assert {n: r["euler"] for n, r in features.items() if r["euler"] != 1} == {"ring": 0}
    assert features["ring"]["holes"] == 1


def test_inner_circle_and_ratio(features):
    assert features["px1"]["inner_radius"] == 0.5
    assert features["sq10"]["inner_radius"] == 4.5
    assert features["disc10"]["inner_radius"] == pytest.approx(10.05 - 0.5, abs=5e-3)
    assert all(0 < r["in_out_ratio"] <= 1 for r in features.values())
    assert features["px1"]["circle_radius"] == pytest.approx(math.sqrt(0.5))


def test_smooth_disc_is_rounder_than_jagged_one(spark, features):
    m = DRAWN[7][1].copy()
    m[::3, :6] = False
    m[::4, -6:] = False
    jagged = Images(mask_pixels(spark, {1: text(m)}), 1000).features.orderBy("area", ascending=False).first()
    assert jagged["roundness"] < features["disc10"]["roundness"]


def test_orientation_points_to_the_far_end(features):
    assert -math.pi < features["L"]["orientation"] <= math.pi
    assert math.degrees(features["L"]["phi"]) == pytest.approx(-45)


def test_a_large_box_does_not_overflow(spark):
    """A filled box of 20,000 by 20,000 pixels, as runs."""
    runs = spark.range(20_000).selectExpr("0L AS image_id", "0L AS region_id", "id AS run_id", "CAST(id AS INT) AS r", "0 AS c0", "19999 AS c1")
    r = shape.invariants(shape.moments(shape.region_base(runs))).first()
    assert r["area"] == 4 * 10**8 and (r["row"], r["col"]) == (9999.5, 9999.5)
    assert r["h1"] == pytest.approx(1 / 6) and r["h4"] == pytest.approx(0, abs=1e-12)


def test_a_thin_diagonal_takes_no_box():
    """A scratch of 50,000 by 50,000 pixels; its box has 2.5 thousand million."""
    n = np.arange(50_000)
    g = geometry.Region(n, n, n + 1)
    assert g.contour_length()[0] == pytest.approx(2 * 49_999 * math.sqrt(2) + 2) and g.filled_area() == (100_000,)
    assert geometry.inner_circle(g.pixels) == (1, 0, 0) and geometry.inner_rectangle(g.pixels) == (2, 0, 0, 0, 1)
    assert geometry.diameter(g.centres)[0] == pytest.approx(math.hypot(49_999, 50_000))
