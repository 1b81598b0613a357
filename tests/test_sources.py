"""Bitmap files, profiles and vectors through files, staged rules, and images that arrive in strips."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from blobweave.operators.choose import defect_codes, rule_rows, select_shape, with_scores
from blobweave.plans.features import Images
from blobweave.plans.staged import codes, group_of, known, selected
from blobweave.sources.bitmaps import BitmapReader, Header, register, write_bitmaps
from blobweave.sources.rasters import mask_pixels
from blobweave.sources.tables import flat, read_csv, read_profile, write_csv
from blobweave.streaming.strips import ROCKS, Block, strip_features

from .masks import text
from .test_bands import MASKS
from .test_properties import flood, runs


@pytest.fixture(scope="module")
def images(spark):
    return Images(mask_pixels(spark, {i: text(m) for i, m in MASKS.items()}), 50, height=40)


def pixels_of(masks):
    return {(i, r, c) for i, m in masks.items() for r, c in np.argwhere(m).tolist()}


def test_bitmaps_there_and_back(spark, images, tmp_path):
    where = str(tmp_path / "masks")
    write_bitmaps(images.runs, where, 37, 40)
    assert (tmp_path / "masks" / "image-3.pbm").read_bytes().startswith(b"P4\n37 40\n") and not list((tmp_path / "masks").glob(".*.pbm"))
    every = spark.read.format("bitmap").option("strip_rows", 6).load(where)
    assert every.dtypes == [("image_id", "bigint"), ("r", "int"), ("c", "int")]
    want = pixels_of(MASKS)
    assert {tuple(r) for r in every.collect()} == want
    part = every.where("image_id = 3 AND r >= 2 AND r < 9 AND c > 3 AND c <= 8")
    assert {tuple(r) for r in part.collect()} == {p for p in want if p[0] == 3 and 2 <= p[1] < 9 and 3 < p[2] <= 8}
    assert every.where("r > 100").count() == 0 and every.where("c < 0").count() == 0


def test_pushed_ranges(tmp_path):
    from pyspark.sql import datasource as D

    (tmp_path / "a-7.pgm").write_bytes(b"P5 # grey\n10 20\n255\n" + bytes(range(200)))
    (tmp_path / "b-8.pgm").write_bytes(b"P5\n2 3\n65535\n" + np.array([0, 300, 70, 0, 0, 9], ">u2").tobytes())
    (tmp_path / "notes-1.txt").write_text("no bitmap")
    reader = BitmapReader({"path": str(tmp_path), "strip_rows": "3", "threshold": "60"})
    left = list(reader.pushFilters([D.GreaterThanOrEqual(("r",), 4), D.LessThan(("r",), 9), D.EqualTo(("c",), 1), D.IsNotNull(("r",)), D.In(("r",), (5,))]))
    assert [type(f) for f in left] == [D.In]
    strips = reader.partitions()
    assert [(s.image_id, s.first, s.last) for s in strips] == [(7, 4, 7), (7, 7, 9)]
    got = [tuple(x.values()) for s in strips for b in reader.read(s) for x in b.to_pylist()]
    assert got == [(7, r, 1) for r in range(6, 9)]
    plain = BitmapReader({"path": str(tmp_path / "b-8.pgm"), "threshold": "60"})
    assert [tuple(x.values()) for s in plain.partitions() for b in plain.read(s) for x in b.to_pylist()] == [(8, 0, 1), (8, 1, 0)]
    with pytest.raises(ValueError, match="kind"):
        Header.read(b"P6\n1 1\n255\n")
    (tmp_path / "short-9.pbm").write_bytes(b"P4\n9 2\n\x01")
    cut = BitmapReader({"path": str(tmp_path / "short-9.pbm")})
    with pytest.raises(ValueError, match="ends before"):
        list(cut.read(cut.partitions()[0]))


def test_empty_folder_of_bitmaps(spark, tmp_path):
    register(spark)
    assert spark.read.format("bitmap").load(str(tmp_path)).count() == 0


PROFILE = "[coater]\narea.vMin=1\narea.vMax=50\nanisometry.vMin=1\nanisometry.vMax=3\nanisometry.dir=decreasing\n[slitter]\nsides.vMin=2\nsides.vMax=2\n"


def test_vectors_with_scores_through_files(spark, images, tmp_path):
    (tmp_path / "p.ini").write_text(PROFILE)
    told = with_scores(images.wanted(["area", "anisometry", "sides", "hu"]), read_profile(spark, str(tmp_path / "p.ini")))
    assert told.schema["coater"].dataType.names == ["anisometry", "area"] and "Exchange" not in with_scores(spark.range(1).select("id", F.lit(1.0).alias("area"), F.lit(1.0).alias("anisometry"), F.lit(1.0).alias("sides")), read_profile(spark, str(tmp_path / "p.ini")))._jdf.queryExecution().executedPlan().toString()
    write_csv(told, str(tmp_path / "csv"))
    back = read_csv(spark, str(tmp_path / "csv"), told.schema)
    assert [(f.name, f.dataType.simpleString()) for f in back.schema] == [(f.name, f.dataType.simpleString()) for f in told.schema]
    key = lambda r: (r["image_id"], r["region_id"])
    a, b = sorted(told.collect(), key=key), sorted(back.collect(), key=key)
    assert a == b
    assert any(r["anisometry"] == math.inf and r["coater"]["anisometry"] == 0 for r in a) and all(r["slitter"]["sides"] is None for r in a) and any(r["sides"] is None for r in a)
    assert flat(told).columns == ["image_id", "region_id", "area", "anisometry", "sides", "hu", "coater_anisometry", "coater_area", "slitter_sides"]
    with pytest.raises(ValueError, match="named as a feature"):
        with_scores(images.wanted(["area"]), spark.createDataFrame([("area", "area", 0.0, 1.0, "increasing")], "process string, feature string, v_min double, v_max double, direction string"))


RULES = [
    ("a", "thin", [("anisometry", 2, math.inf), ("convexity", 0, 0.8)]),
    ("a", "holed", [("area", 20, 1000), ("holes", 1, 99), ("area_holes", 3, 999)]),
    ("b", "round", [("circularity", 0.2, 1), ("inner_radius", 1, 99)]),
    ("b", "any", [("runs", 1, 9)]),
]


def test_staged_rules(spark, images):
    rules = rule_rows(spark, RULES)
    features = images.wanted(sorted({f for _, _, cs in RULES for f, _, _ in cs}))
    want, got = (sorted(map(tuple, df.collect())) for df in (defect_codes(features, rules), codes(images, rules)))
    assert got == want and {r[3] for r in want} == {"thin", "holed", "round", "any"}
    first = {"a": ("holed", 1)}
    order = {"holed": 0, "thin": 1}
    assert sorted(map(tuple, codes(images, rules, order).collect())) == sorted(map(tuple, defect_codes(features, rules, order).collect())) and first
    assert codes(images, rule_rows(spark, [])).count() == 0
    with pytest.raises(ValueError, match="no such"):
        codes(images, rule_rows(spark, [("a", "x", [("size", 0, 1)])]))
    assert [group_of(n) for n in ("area", "circularity", "holes", "convexity", "in_out_ratio")] == [0, 1, 2, 3, 5]


def test_staged_selection(spark, images):
    names, lo, hi = ["area", "holes", "inner_radius"], [10, 0, 0.5], [200, 1, 9]
    want = select_shape(images.wanted(names), names, lo, hi)
    got = selected(images, names, lo, hi)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.count("MapInArrow") >= 2
    more = known(images, [[("area", 10, 200)]], ["diameter"]).toPandas()
    assert (more.area >= 10).all() and (more.diameter > 0).all()


# --- strips


def rows_of(mask):
    out = {r: [] for r in range(len(mask))}
    for r, a, b in zip(*runs(mask), strict=True):
        out[int(r)].append((int(a), int(b)))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_blocks_in_any_order(seed):
    rng = np.random.default_rng(seed)
    for mask in list(MASKS.values())[:20]:
        rows = rows_of(mask)
        blocks, parts = {}, []
        for r in rng.permutation(len(mask)).tolist():
            flat_ = np.array(rows[r], np.int64).reshape(-1, 2)
            b = Block.of(r, r, np.full(len(flat_), r), flat_[:, 0], flat_[:, 1], 50)
            for other in [x for x in blocks.values() if x.last + 1 == b.first]:
                b = b.under(blocks.pop(other.first))
            for other in [x for x in blocks.values() if b.last + 1 == x.first]:
                b = blocks.pop(other.first).under(b)
            parts.append(b.finished(None))
            blocks[b.first] = Block.unpack(b.first, b.last, b.pack())
        (last,) = blocks.values()
        parts.append(last.parts)
        got = {p[0]: tuple(p[1:].tolist()) for p in np.concatenate(parts)}
        labels = flood(mask, 2)
        want = {}
        for k in range(1, labels.max() + 1):
            p = np.argwhere(labels == k)
            want[p[0][0] * 50 + p[0][1]] = (len(p), p[:, 0].sum(), 2 * p[:, 1].sum(), *p.min(0), *p.max(0))
        assert got == want


def test_strips_in_a_stream(spark, images, tmp_path):
    rng = np.random.default_rng(1)
    table = [(i, r, [(a, b) for a, b in found], 86_400 + 10 * int(rng.integers(0, 5))) for i, m in MASKS.items() for r, found in rows_of(m).items()]
    kind = "image_id long, r int, runs array<struct<c0:int,c1:int>>, s long"
    order = rng.permutation(len(table))
    for k, part in enumerate(np.array_split(order, 3)):
        again = [table[order[0]]] if k else []  # a row comes again
        spark.createDataFrame([table[i] for i in part] + again, kind).withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    spark.createDataFrame([(-5, 0, [], 10**6)], kind).withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1).write.parquet(str(tmp_path / "in" / "3"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    schema = spark.read.parquet(str(tmp_path / "in" / "0")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*")).withWatermark("ts", "10 minutes")
    query = strip_features(stream, 50).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r["image_id"], r["region_id"]): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = images.wanted(["area", "row", "col", "r1", "c1", "r2", "c2"]).collect()
    assert len(got) == len(want)
    for r in want:
        g = got[r["image_id"], r["region_id"]]
        assert all(g[n] == pytest.approx(r[n]) for n in ("area", "row", "col", "r1", "c1", "r2", "c2"))
