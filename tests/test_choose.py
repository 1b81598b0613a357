"""Selection, scores, codes, profiles, CSV and micro-batches."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from blobweave.operators.choose import PROCESS_FEATURES, defect_codes, process_rules, rule_rows, score, scores, select_shape
from blobweave.plans.features import FEATURES, Images
from blobweave.sources.rasters import emb_pixels, mask_pixels
from blobweave.sources.tables import PROFILE, parse_profile, read_profile, write_csv
from blobweave.streaming.micro_batch import stream_features

from .masks import DRAWN, text

INF = math.inf


@pytest.fixture(scope="module")
def features(spark):
    return Images(mask_pixels(spark, {i: text(m) for i, (_, m) in DRAWN.items() if i != 8}), 1000, 300).features.persist()


def ids(df):
    return {DRAWN[r["image_id"]][0] for r in df.collect()}


def test_select_is_closed_and_null_never_matches(features):
    assert ids(select_shape(features, ["area"], [4], [20])) == {"sq2", "line1x20"}
    assert "px1" not in ids(select_shape(features, ["sides"], [-INF], [INF]))
    assert ids(select_shape(features, ["anisometry"], [100], [INF])) == {"line1x20"}
    assert ids(select_shape(features, ["area", "holes"], [900, 1], [1000, 9], "or")) == {"ring"}
    assert len(ids(select_shape(features, [], [], []))) == 12 and not ids(select_shape(features, [], [], [], "or"))
    for bad in (lambda: select_shape(features, ["nope"], [0], [1]), lambda: select_shape(features, ["area"], [0], []), lambda: select_shape(features, ["area"], [0], [1], "xor")):
        with pytest.raises(ValueError):
            bad()


def test_score(spark):
    rows = [(v, a, b, d) for v in (None, 0.0, 5.0, 10.0, 12.0, INF) for a, b in ((0.0, 10.0), (3.0, 3.0)) for d in ("increasing", "decreasing")]
    df = spark.createDataFrame(rows, "v double, a double, b double, d string")
    got = [r[0] for r in df.select(score(F.col("v"), F.col("a"), F.col("b"), F.col("d"))).collect()]
    for (v, a, b, d), s in zip(rows, got, strict=True):
        want = None if v is None or a == b else 100 * min(1, max(0, (v - a) / (b - a)))
        assert s == (want if want is None or d == "increasing" else 100 - want)


def test_profile(spark, features, tmp_path):
    path = tmp_path / "p.ini"
    path.write_text("[coater]\narea.vMin = 0\narea.vMax = 100\n[slitter]\nsides.vMin=0\nsides.vMax=4\nsides.dir=decreasing\n")
    profile = read_profile(spark, str(path), set(FEATURES))
    got = {(DRAWN[r["image_id"]][0], r["feature"]): r["score"] for r in scores(features, profile).collect()}
    assert got["sq2", "area"] == 4 and got["L", "area"] == 100 and got["px1", "sides"] is None
    for bad in ("[a]\nnope.vMin=0\nnope.vMax=1", "[a]\narea.vMin=0", "[a]\narea.vMin=0\narea.vMax=1\narea.dir=up"):
        with pytest.raises(ValueError):
            parse_profile(bad, set(FEATURES))
    assert not scores(features, spark.createDataFrame([], PROFILE)).count()


def test_codes(spark, features):
    rules = rule_rows(spark, [("p", "big", [("area", 900, INF)]), ("p", "holed", [("holes", 1, INF), ("area", 0, INF)]), ("q", "line", [("anisometry", 10, INF)])])
    got = {(DRAWN[r["image_id"]][0], r["process"], r["code"]) for r in defect_codes(features, rules).collect()}
    assert {x for x in got if x[0] in ("ring", "line1x20")} == {("ring", "p", "big"), ("ring", "p", "holed"), ("line1x20", "q", "line")}
    one = {DRAWN[r["image_id"]][0]: r["code"] for r in defect_codes(features, rules, {"holed": 1, "big": 2}).where("process = 'p'").collect()}
    assert one["ring"] == "holed" and one["ell_semi"] == "big"


@pytest.mark.parametrize("process", PROCESS_FEATURES)
def test_process_rules(spark, features, process):
    told = {code: {f: (0.0, INF) for f in fs} for code, fs in PROCESS_FEATURES[process].items()}
    assert defect_codes(features, process_rules(spark, process, told)).count()
    with pytest.raises(ValueError):
        process_rules(spark, process, {})


def test_csv(spark, features, tmp_path):
    write_csv(features.withColumn("box", F.struct("r1", "c1")), str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() == features.count() and {"box_r1", "hu", "area"} <= set(back.columns)
    assert len(back.first()["hu"].split()) == 7


def test_micro_batches_equal_a_batch(spark, tmp_path):
    pixels = emb_pixels(spark, "/root/testdata/sf0.001")
    for i in range(4):  # an image is in one file
        pixels.where(F.pmod("image_id", F.lit(4)) == i).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(pixels.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = stream_features(stream, 64, lambda df, n: df.select("image_id", "region_id", "area", "contlength").write.parquet(str(tmp_path / "out" / str(n))), str(tmp_path / "check"), once=True)
    query.awaitTermination(300)
    out = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "out"))
    want = Images(pixels, 64).features.select("image_id", "region_id", "area", "contlength")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
