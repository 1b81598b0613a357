"""Work that must be dealt out: no step in one task, none done twice, none more costly than it has to be."""

from __future__ import annotations

import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from blobweave.functions import geometry as kernels
from blobweave.functions.geometry import FAMILIES, _shape_figures, figures, geometry, measure
from blobweave.operators.regions import RUNS, by_region
from blobweave.plans import queries
from blobweave.plans.features import Images
from blobweave.plans.queries import emb
from blobweave.plans.staged import known

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_rows_for_strips_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "fresh", lambda _, what: str(tmp_path / what))
    got = queries.QUERIES["q40_strip_stream"](spark, DATA)
    assert len([f for f in os.listdir(tmp_path / "strips" / "in" / "0") if f.endswith(".parquet")]) > 1
    rows = spark.read.parquet(str(tmp_path / "strips" / "in" / "0"))
    assert rows.count() == spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    want = queries.rounded(emb(spark, DATA).wanted(["area", "row", "col", "r1", "c1", "r2", "c2"]))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_kernels_are_dealt_to_all_tasks(spark):
    """Few bytes of runs are much work: an adaptive plan must not put them together, after a semi-join either."""
    runs = spark.createDataFrame([(i, 0, 0, r, 0, 1) for i in range(40) for r in range(3)], RUNS)
    im = Images(None, 64, 64, runs)
    im.__dict__["regions"] = runs
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for regions in (runs, im.of(runs.where("image_id < 35").select("image_id", "region_id").distinct()).regions):
            tasks = geometry(regions, ["links"]).select(F.spark_partition_id().alias("p")).distinct().count()
            assert tasks > 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def test_a_shape_is_measured_once_and_moved(monkeypatch):
    calls = []
    columns, found = FAMILIES["inner_rect"]
    monkeypatch.setitem(FAMILIES, "inner_rect", (columns, lambda g: calls.append(1) or found(g)))
    kernel = measure(tuple(FAMILIES))
    ring = tuple(np.array(x) for x in ([0, 1, 1, 2, 3], [0, 0, 2, 0, 1], [2, 0, 2, 2, 1]))
    _shape_figures.cache_clear()
    for down, right in ((0, 0), (7, 3), (40, 1000)):
        moved = (ring[0] + down, ring[1] + right, ring[2] + right)
        got = kernel(*moved)
        assert len(calls) == 1
        assert got[0] == pytest.approx(figures(tuple(f for f in FAMILIES), *moved))
        calls.pop()
    _shape_figures.cache_clear()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_stages_of_rules_are_done_once(spark, tmp_path, monkeypatch):
    """Later stages read what is left of earlier ones, which is kept: no region goes through a kernel twice."""
    log = str(tmp_path / "calls")

    def counted(rows, columns, kernel, schema, *keys):
        def noted(*runs):
            with open(log, "a") as f:
                f.write(f"{schema}\n")
            return kernel(*runs)

        return by_region(rows, columns, noted, schema, *keys)

    monkeypatch.setattr("blobweave.functions.geometry.by_region", counted)
    im = emb(spark, DATA)
    n = im.regions.select("image_id", "region_id").distinct().count()
    rules = [[("area", 1, 999), ("holes", 0, 9), ("convexity", 0, 1), ("contlength", 0, 99)]]
    assert known(im, rules).count() > 0
    with open(log) as f:
        calls = Counter(f.read().splitlines())
    assert len(calls) == 3 and max(calls.values()) <= n


def test_regions_without_holes_are_not_filled(monkeypatch):
    """Links tell that there is no hole, and windows take the rows that a region has."""
    cup = (np.array([0, 0, 1, 1, 2]), np.array([0, 3, 0, 3, 0]), np.array([0, 3, 0, 3, 3]))
    ring = (np.array([0, 1, 1, 2]), np.array([0, 0, 3, 0]), np.array([3, 0, 3, 3]))
    assert kernels.figures(("fill", "links"), *ring) == (12, 4) and kernels.figures(("fill", "links"), *cup) == (8, 4)
    want = kernels.figures(("roundness", "contour"), *cup)
    monkeypatch.setattr(kernels, "filled", lambda *runs: pytest.fail("filled"))
    assert kernels.figures(("roundness", "contour"), *cup) == want
    made, zeros = [], np.zeros
    monkeypatch.setattr(kernels.np, "zeros", lambda shape, *a, **b: made.append(shape) or zeros(shape, *a, **b))
    kernels.windows(*cup)
    assert made == [(5, 7)]
