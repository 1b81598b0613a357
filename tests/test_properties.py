"""Random masks against brute force, and features that moves must not change."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest

from blobweave.functions import geometry as G
from blobweave.operators.regions import filled, regions_of, runs_of
from blobweave.plans.features import Images
from blobweave.sources.rasters import mask_pixels

from .masks import text


def flood(mask: np.ndarray, reach: int) -> np.ndarray:
    """Labels from 1 of the components that steps of |dr| + |dc| <= reach join (reach 2: also diagonal)."""
    out = np.zeros(mask.shape, int)
    label = 0
    for start in zip(*np.nonzero(mask), strict=True):
        if out[start]:
            continue
        label += 1
        out[start], todo = label, [start]
        while todo:
            r, c = todo.pop()
            for dr, dc in itertools.product((-1, 0, 1), repeat=2):
                p = (r + dr, c + dc)
                if abs(dr) + abs(dc) <= reach and 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and not out[p]:
                    out[p] = label
                    todo.append(p)
    return out


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = []
    for r, line in enumerate(mask):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], line.astype(int), [0]])))
        rows += [(r, a, b - 1) for a, b in edge.reshape(-1, 2)]
    return tuple(np.array(x) for x in zip(*rows, strict=True))


def blobs(n: int, size: int, share: float, seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        labels = flood(rng.random((size, size)) < share, 2)
        if labels.max():
            out.append(labels == np.bincount(labels.ravel())[1:].argmax() + 1)
    return out


BLOBS = blobs(60, 12, 0.45, 3)


@pytest.mark.parametrize("mask", BLOBS[:40], ids=range(40))
def test_figures_of_a_blob(mask):
    r, c0, c1 = runs(mask)
    pixels = np.argwhere(mask)
    outside = flood(np.pad(~mask, 1, constant_values=True), 1)
    full = (outside != outside[0, 0])[1:-1, 1:-1]
    fr, fa, fb = filled(r, c0, c1)
    again = np.zeros_like(mask)
    for y, a, b in zip(fr, fa, fb, strict=True):
        again[y, a : b + 1] = True
    assert (again == full).all()

    d2 = ((pixels[:, None] - pixels) ** 2).sum(2)
    assert G.diameter(G.centre_hull(r, c0, c1))[0] == pytest.approx(math.sqrt(d2.max()))

    corners = G.corner_hull(r, c0, c1)
    every = np.unique(np.concatenate([pixels + d for d in itertools.product((0, 1), repeat=2)]), axis=0)
    area = G.polygon_area(corners)
    assert mask.sum() <= area + 1e-9
    row, col, phi, long, short = G.rectangle2(corners)
    assert 4 * long * short >= area - 1e-9
    u = (every[:, 1] - 0.5 - col) * math.cos(phi) - (every[:, 0] - 0.5 - row) * math.sin(phi)
    v = (every[:, 1] - 0.5 - col) * math.sin(phi) + (every[:, 0] - 0.5 - row) * math.cos(phi)
    assert abs(u).max() == pytest.approx(long) and abs(v).max() == pytest.approx(short)
    # no turn by whole degrees gives a smaller rectangle
    angles = np.radians(np.arange(90))[:, None]
    w = np.ptp(every[:, 1] * np.cos(angles) - every[:, 0] * np.sin(angles), axis=1) * np.ptp(every[:, 1] * np.sin(angles) + every[:, 0] * np.cos(angles), axis=1)
    assert 4 * long * short <= w.min() + 1e-9

    y, x, radius = G.enclosing_circle(corners)
    far = np.hypot(every[:, 0] - 0.5 - y, every[:, 1] - 0.5 - x)
    assert far.max() <= radius + 1e-9
    best = min(_circles(corners))
    assert radius == pytest.approx(best)

    back = np.argwhere(~np.pad(mask, 1)) - 1
    here = G.Pixels(r, c0, c1)
    assert (np.column_stack([here.r, here.c]) == pixels).all()
    want = ((pixels[:, None] - back) ** 2).sum(2).min(1)
    assert (G.squared_distance(here) == want).all()

    k = int(np.argmax(want))
    assert G.inner_circle(here) == (want[k], *pixels[k])

    size, r1, k1, r2, k2 = G.inner_rectangle(here)
    boxes = [(-(b - a + 1) * (d - c + 1), a, c, b, d) for a in range(12) for b in range(a, 12) for c in range(12) for d in range(c, 12) if mask[a : b + 1, c : d + 1].all()]
    assert (-size, r1, k1, r2, k2) == min(boxes)


def _circles(h: np.ndarray) -> list[float]:
    """Radii of the circles through two or three of the points that hold all of them."""
    out = []
    p = h.astype(float)
    for i, j in itertools.combinations(range(len(p)), 2):
        c, rad = (p[i] + p[j]) / 2, math.dist(p[i], p[j]) / 2
        if np.hypot(*(p - c).T).max() <= rad + 1e-9:
            out.append(rad)
    for i, j, k in itertools.combinations(range(len(p)), 3):
        m = 2 * np.array([p[j] - p[i], p[k] - p[i]])
        if abs(np.linalg.det(m)) > 1e-9:
            c = p[i] + np.linalg.solve(m, ((p[[j, k]] - p[i]) ** 2).sum(1))
            rad = math.dist(c, p[i])
            if np.hypot(*(p - c).T).max() <= rad + 1e-9:
                out.append(rad)
    return out


def moore_length(mask: np.ndarray) -> float:
    """Length of the outer contour by tracing it around."""
    m = np.pad(mask, 1)
    ring = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]
    start = tuple(np.argwhere(m)[0])
    at, came, total, first = start, 0, 0.0, None
    while True:
        for k in range(8):
            d = (came + k) % 8
            p = (at[0] + ring[d][0], at[1] + ring[d][1])
            if m[p]:
                break
        else:
            return 0.0
        if (at, d) == first:
            return total
        first = first or (at, d)
        total += math.hypot(*ring[d])
        at, came = p, (d + 6) % 8 if d % 2 == 0 else (d + 5) % 8


def test_features_of_blobs(spark):
    got = {r["image_id"]: r for r in Images(mask_pixels(spark, {i: text(m) for i, m in enumerate(BLOBS)}), 100, 12).features.collect()}
    assert len(got) == len(BLOBS)
    for i, m in enumerate(BLOBS):
        r, p = got[i], np.argwhere(m).astype(float)
        n, d = len(p), p - p.mean(0)
        assert r["area"] == n and (r["row"], r["col"]) == pytest.approx(tuple(p.mean(0)))
        assert (r["mu_rr"], r["mu_cc"], r["mu_rc"]) == pytest.approx(((d[:, 0] ** 2).mean(), (d[:, 1] ** 2).mean(), (d[:, 0] * d[:, 1]).mean()))
        e30, e12, e21, e03 = ((d[:, 0] ** a * d[:, 1] ** b).sum() / n**2.5 for a, b in ((3, 0), (1, 2), (2, 1), (0, 3)))
        assert r["h4"] == pytest.approx((e30 + e12) ** 2 + (e21 + e03) ** 2, abs=1e-12)
        background = flood(np.pad(~m, 1, constant_values=True), 1)
        assert r["holes"] == background.max() - 1 == 1 - r["euler"]
        assert r["contlength"] == pytest.approx(moore_length(background[1:-1, 1:-1] != background[0, 0]))
        assert r["circularity"] is None or 0 < r["circularity"] <= 1
        assert 0 < r["convexity"] <= 1 + 1e-12 and 0 < r["rectangularity"] <= 1 + 1e-12
        assert r["anisometry"] is None or r["anisometry"] >= 1


MOVED = ["area", "contlength", "diameter", "circularity", "compactness", "convexity", "rectangularity", "roundness", "ra", "rb", "h1", "h2", "h3", "h4", "h7", "inner_radius", "circle_radius", "euler"]


def test_moves_and_turns(spark):
    masks = BLOBS[40:]
    shifted = {i: text(np.pad(m, ((7, 0), (11, 0)))) for i, m in enumerate(masks)}
    turned = {i: text(np.rot90(m)) for i, m in enumerate(masks)}
    plain, other, turn = ({r["image_id"]: r for r in Images(mask_pixels(spark, x), 100, 30).features.collect()} for x in ({i: text(m) for i, m in enumerate(masks)}, shifted, turned))
    for i in plain:
        for name in MOVED:
            a = plain[i][name]
            for b in (other[i][name], turn[i][name]):
                assert (a is None) == (b is None) and (a is None or b == pytest.approx(a, abs=1e-9)), name


@pytest.mark.parametrize("band", [1, 3, 4096])
def test_regions_do_not_depend_on_bands(spark, band):
    rng = np.random.default_rng(5)
    masks = {i: rng.random((20, 17)) < 0.4 for i in range(6)}
    pixels = mask_pixels(spark, {i: text(m) for i, m in masks.items()})
    got = regions_of(runs_of(pixels.union(pixels), 50), band_rows=band).collect()
    for i, m in masks.items():
        labels = flood(m, 2)
        mine = [r for r in got if r["image_id"] == i]
        assert sum(r["c1"] - r["c0"] + 1 for r in mine) == m.sum()
        pairs = {(labels[r["r"], r["c0"]], r["region_id"]) for r in mine}
        assert len(pairs) == labels.max() == len({b for _, b in pairs})
        assert all(min(r["run_id"] for r in mine if r["region_id"] == b) == b for _, b in pairs)
