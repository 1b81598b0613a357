"""Regions cut into bands give what whole regions give; large regions take little time and no task of their own."""

from __future__ import annotations

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from blobweave.functions import geometry as G
from blobweave.functions import shape
from blobweave.operators import contract
from blobweave.operators.regions import fill_up, regions_of, runs_of
from blobweave.plans.features import Images
from blobweave.sources.rasters import array_runs, mask_pixels
from blobweave.streaming.micro_batch import stream_features

from .masks import disc, text
from .test_properties import blobs, runs

FAMILIES = list(G.FAMILIES)


def spiral(n: int) -> np.ndarray:
    """A winding region whose background reaches its middle only along a long way."""
    m = np.zeros((n, n), bool)
    r0, c0, r1, c1 = 0, 0, n - 1, n - 1
    while r1 - r0 > 3:
        m[r0, c0 : c1 + 1] = m[r0 : r1 + 1, c1] = m[r1, c0 : c1 + 1] = m[r0 + 2 : r1 + 1, c0] = True
        m[r0 + 2, c0 : c0 + 2] = True
        r0, c0, r1, c1 = r0 + 2, c0 + 2, r1 - 2, c1 - 2
    return m


MASKS = dict(enumerate([*blobs(12, 14, 0.5, 8), *blobs(8, 14, 0.8, 9), spiral(13), spiral(22), disc(9, 5), np.ones((1, 9), bool), np.ones((9, 1), bool), np.ones((1, 1), bool)]))


@pytest.fixture(scope="module")
def pixels(spark):
    return mask_pixels(spark, {i: text(m) for i, m in MASKS.items()})


def values(df, names):
    return {(r["image_id"], r["region_id"]): [r[n] for n in names] for r in df.collect()}


@pytest.mark.parametrize("band_rows", [1, 3])
def test_figures_by_band(spark, pixels, band_rows):
    whole, cut = Images(pixels, 50, height=40), Images(pixels, 50, band_rows=band_rows)
    one, two = whole.figures(*FAMILIES), cut.figures(*FAMILIES)
    assert one.columns == two.columns
    a, b = values(one, one.columns), values(two, one.columns)
    assert a.keys() == b.keys()
    for key in a:
        for name, x, y in zip(one.columns, a[key], b[key], strict=True):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)), (key, name, x, y)
    for im in (whole, cut):
        im.release()


@pytest.mark.parametrize("band_rows", [2])
def test_filling_by_band(spark, pixels, band_rows):
    regions = regions_of(runs_of(pixels, 50), height=40).persist()
    names = ["image_id", "region_id", "r", "c0", "c1"]
    want, got = (sorted(tuple(r) for r in df.select(*names).collect()) for df in (fill_up(regions), fill_up(regions, band_rows=band_rows, width=50)))
    assert got == want
    regions.unpersist()


def test_no_region_in_one_task(pixels):
    plan = Images(pixels, 50, band_rows=3).figures("hull", "links", "inner_rect")._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "band" in physical


@pytest.mark.parametrize("most", [0, 10**6])
def test_roots(spark, monkeypatch, most):
    monkeypatch.setattr(contract, "LINKS_IN_TASK", most)
    rng = np.random.default_rng(2)
    rows = {(int(k), *map(int, rng.integers(0, 300, 2))) for k in rng.integers(0, 3, 500)} | {(7, i, i + 1) for i in range(60)} | {(8, 4, 4)}
    links = spark.createDataFrame(sorted(rows), "image_id long, a long, b long").repartition(4)
    got = {(r["image_id"], r["label"]): r["root"] for r in contract.roots_of(links, ["image_id"]).collect()}
    for k in {k for k, _, _ in rows}:
        own = [(a, b) for i, a, b in rows if i == k]
        top = contract.joined(301, *np.array(own).T)
        assert all(got.get((k, n), n) == top[n] for n in range(301))
    assert contract.roots_of(links.limit(0), ["image_id"]).count() == 0


def test_one_image_of_many_bands(spark):
    rng = np.random.default_rng(1)
    m = rng.random((400, 90)) < 0.45
    pixels = mask_pixels(spark, {3: text(m)})
    one = values(regions_of(runs_of(pixels, 100), height=400).withColumnRenamed("region_id", "x").withColumn("region_id", F.col("run_id")), ["x"])
    many = values(regions_of(runs_of(pixels, 100), band_rows=2).withColumnRenamed("region_id", "x").withColumn("region_id", F.col("run_id")), ["x"])
    assert one == many and len(one) > 1000


def test_large_region_over_many_bands(spark):
    """A disc of 3.1 million pixels in strips of 64 rows, from runs alone."""
    radius = 1000
    rows = spark.range(-radius, radius + 1).select(F.lit(1).cast("long").alias("image_id"), (F.col("id") + radius).cast("int").alias("r"), F.floor(F.sqrt(F.lit(radius * radius) - F.col("id") * F.col("id"))).cast("int").alias("half"))
    made = rows.select("image_id", (F.col("r").cast("long") * 4000 + radius - F.col("half")).alias("run_id"), "r", (radius - F.col("half")).alias("c0"), (radius + F.col("half")).alias("c1"))
    im = Images(None, 4000, given=made, band_rows=64)
    got = im.wanted(["area", "area_holes", "diameter", "inner_radius", "inner_row", "inner_col", "circle_radius", "convexity", "contlength", "euler"]).collect()
    im.release()
    assert len(got) == 1
    r = got[0]
    assert r["area"] == pytest.approx(math.pi * radius**2, rel=1e-4) and r["area_holes"] == 0 and r["euler"] == 1 and r["diameter"] == 2 * radius
    assert (r["inner_row"], r["inner_col"]) == (radius, radius) and r["inner_radius"] == pytest.approx(radius - 0.5, abs=0.01) and 0.99 < r["convexity"] <= 1


def test_inscribed_figures_take_linear_time():
    p = G.Pixels(*runs(disc(800)))
    began = time.process_time()
    assert G.inner_circle(p) == (640_001, 801, 801)
    assert time.process_time() - began < 2
    began = time.process_time()
    assert G.inner_rectangle(p)[0] == 1_281_423
    assert time.process_time() - began < 1
    wide = np.ones((9, 30_000), bool)
    wide[4, 10] = False
    assert G.inner_circle(G.Pixels(*runs(wide))) == (25, 4, 4)
    every = np.random.default_rng(4).random((200, 300)) < 0.99
    d2 = G.squared_distance(G.Pixels(*runs(every)))
    back, on = np.argwhere(~np.pad(every, 1)) - 1, np.argwhere(every)
    some = np.random.default_rng(5).choice(len(on), 500)
    assert (((on[some][:, None] - back) ** 2).sum(2).min(1) == d2[some]).all()


def test_runs_within_the_scan(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [None if x > 0.95 else float(x) for x in rng.random(rng.integers(0, 40))]) for i in range(60)] + [(70, None), (71, [1.0] * 5)]
    table = spark.createDataFrame(rows, "id long, v array<double>")
    image, r = F.floor(F.col("id") / 8), F.col("id") % 8
    want = runs_of(table.select(image.cast("long").alias("image_id"), r.cast("int").alias("r"), F.posexplode("v").alias("c", "x")).where("x > 0.4"), 64)
    made = array_runs(table, image, r, F.col("v"), 0.4, 64)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert made.dtypes == want.dtypes and sorted(map(tuple, made.collect())) == sorted(map(tuple, want.collect()))
    # rows in pieces of seven columns
    pieces = table.where("v IS NOT NULL").select("id", "v", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("v") - 1), F.lit(7))).alias("b"))
    pieces = pieces.withColumn("v", F.slice("v", F.col("b") + 1, F.lit(7)))
    cut = array_runs(pieces, image, r, F.col("v"), 0.4, 64, F.col("b"))
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, want.collect()))


def test_features_do_not_depend_on_bands(spark, pixels):
    names = ["area", "circularity", "orientation", "area_holes", "compactness", "convexity", "h3", "euler", "in_out_ratio", "roundness"]
    whole, cut = Images(pixels, 50, height=40), Images(pixels, 50, band_rows=4)
    a, b = values(whole.wanted(names), names), values(cut.wanted(names), names)
    assert a.keys() == b.keys()
    for key in a:
        for name, x, y in zip(names, a[key], b[key], strict=True):
            assert x == y or (x is not None and y is not None and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)), (key, name)
    kept = len(spark.sparkContext._jsc.getPersistentRDDs())
    assert kept
    for im in (whole, cut):
        im.release()
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) < kept


def test_moments_of_large_boxes(spark):
    """Boxes beyond those whose products of sums are exact, in one table with a small one."""
    rng = np.random.default_rng(3)
    rows = [(1, g, 0, int(r), int(c), int(c + n)) for g, size in ((1, 900_000), (2, 300)) for r, c, n in zip(rng.integers(0, size, 60), rng.integers(0, size, 60), rng.integers(0, 60, 60), strict=True)]
    base = shape.region_base(spark.createDataFrame(rows, "image_id long, region_id long, run_id long, r int, c0 int, c1 int"))
    for got in shape.eccentricity(shape.invariants(shape.moments(base))).collect():
        p = np.array([(r, c) for _, g, _, r, a, b in rows if g == got["region_id"] for c in range(a, b + 1)], float)
        d = p - p.mean(0)
        assert (got["row"], got["col"]) == pytest.approx(tuple(p.mean(0))) and got["area"] == len(p)
        assert (got["mu_rr"], got["mu_cc"], got["mu_rc"]) == pytest.approx(((d[:, 0] ** 2).mean(), (d[:, 1] ** 2).mean(), (d[:, 0] * d[:, 1]).mean()), rel=1e-9)
        e30, e12, e21, e03 = ((d[:, 0] ** a * d[:, 1] ** b).sum() / len(p) ** 2.5 for a, b in ((3, 0), (1, 2), (2, 1), (0, 3)))
        assert got["h4"] == pytest.approx((e30 + e12) ** 2 + (e21 + e03) ** 2, rel=1e-6)
        assert got["h3"] == pytest.approx((e30 - 3 * e12) ** 2 + (3 * e21 - e03) ** 2, rel=1e-6)


def test_batches_leave_nothing_cached(spark, tmp_path):
    for k in range(3):
        mask_pixels(spark, {k: text(MASKS[k])}).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    stream = spark.readStream.schema("image_id long, r int, c int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    seen = []
    query = stream_features(stream, 50, lambda features, n: seen.append((n, features.select("area", "euler").count())), str(tmp_path / "state"), once=True)
    query.awaitTermination()
    assert len(seen) == 3 and len(spark.sparkContext._jsc.getPersistentRDDs()) == before
