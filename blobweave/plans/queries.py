"""The region queries by name, over images made from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import shape
from ..functions.geometry import geometry
from ..functions.shape import KEY
from ..operators.choose import rule_rows, scores, select_shape, with_scores
from ..operators.outline import chain_length
from ..operators.regions import fill_up, runs_of, shuffle_tasks
from ..operators.staging import fresh
from ..sources.bitmaps import write_bitmaps
from ..sources.rasters import EMB_HEIGHT, EMB_WIDTH, LI_HEIGHT, LI_WIDTH, emb_runs, li_pixels
from ..sources.tables import PROFILE, flat, parse_profile, read_csv, read_profile, write_csv
from ..streaming.strips import OUT as STRIPS
from ..streaming.strips import ROCKS, strip_features
from .features import FEATURES, Images, image_topology
from .staged import codes, selected

PROFILE_INI = """
[coater]
area.vMin = 1
area.vMax = 50
convexity.vMin = 0.4
convexity.vMax = 1
convexity.dir = decreasing
[roll_press]
anisometry.vMin = 1
anisometry.vMax = 6
k_factor.vMin = 0.5
k_factor.vMax = 3
k_factor.dir = decreasing
[slitter]
roundness.vMin = 0.2
roundness.vMax = 1
roundness.dir = decreasing
"""
INF = float("inf")
#: Batches of the rows of _strip_stream.
STRIP_BATCHES = 3
RULES = [
    ("coater", "bubbles", [("holes", 1, INF), ("euler", -INF, 0)]),
    ("coater", "tear", [("convexity", 0, 0.6), ("area", 5, INF)]),
    ("roll_press", "wrinkle", [("anisometry", 3, INF)]),
    ("slitter", "burr", [("roundness", 0, 0.5)]),
]


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, without negative zero, and wide decimals as long, for comparison with SQL."""
    out = []
    for f in df.schema:
        kind, c = f.dataType.simpleString(), F.col(f.name)
        out.append((F.round(c, 6) + F.lit(0.0)).alias(f.name) if kind == "double" else c.cast("long").alias(f.name) if kind.startswith(("decimal", "int")) else c)
    return df.select(*out)


def emb(spark: SparkSession, sf_dir: str) -> Images:
    return Images(None, EMB_WIDTH, EMB_HEIGHT, emb_runs(spark, sf_dir))


def _of(make: Callable[[Images], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(make(emb(spark, sf_dir)))


def _features(*names: str) -> Callable[[SparkSession, str], DataFrame]:
    """Features of the regions of the embedding images, with the region's key."""
    return _of(lambda im: im.wanted(list(names)))


def _figures(family: str) -> Callable[[SparkSession, str], DataFrame]:
    return _of(lambda im: im.figures(family))


def _orientation(im: Images) -> DataFrame:
    return im.moments.join(im.far, KEY).select(*KEY, shape.orientation().alias("orientation"), "far_r", "far_c")


def _circularity(im: Images) -> DataFrame:
    return im.moments.join(im.far, KEY).select(*KEY, "max_distance", shape.circularity().alias("circularity"))


def _area_holes(im: Images) -> DataFrame:
    full = fill_up(im.regions).groupBy(*KEY).agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("filled_area"))
    return im.base.join(full, KEY).select(*KEY, "filled_area", (F.col("filled_area") - F.col("area")).alias("area_holes"))


def _convexity(im: Images) -> DataFrame:
    met = im.base.select(*KEY, "area").join(geometry(im.regions, ["hull"]), KEY)
    return met.select(*KEY, "hull_area", (F.col("area") / F.col("hull_area")).alias("convexity"))


def _select_or(im: Images) -> DataFrame:
    return select_shape(im.wanted(["area", "anisometry", "holes"]), ["area", "anisometry", "holes"], [10, 1.5, 1], [100, INF, INF], "or")


def _scores(im: Images) -> DataFrame:
    told = parse_profile(PROFILE_INI)
    return scores(im.wanted([row[1] for row in told]), im.runs.sparkSession.createDataFrame(told, PROFILE))


def _li_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(runs_of(li_pixels(spark, sf_dir), LI_WIDTH))


def _li_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    im = Images(li_pixels(spark, sf_dir), LI_WIDTH, LI_HEIGHT)
    return rounded(im.once.groupBy(*KEY).agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("area"), F.count("*").alias("runs")))


def _outer_contour(im: Images) -> DataFrame:
    return im.contour


def _chain_length(im: Images) -> DataFrame:
    return chain_length(im.contour)


def _staged_select(im: Images) -> DataFrame:
    return selected(im, ["area", "anisometry", "holes"], [10, 1.5, 1], [100, INF, INF])


def _staged_codes(rules: list) -> Callable[[Images], DataFrame]:
    return lambda im: codes(im, rule_rows(im.runs.sparkSession, rules))


def _scored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a profile file to feature vectors with scores, to CSV files, and back."""
    where = fresh(spark, "scored")
    spark.createDataFrame([(PROFILE_INI,)], "value string").coalesce(1).write.text(f"{where}/profile")
    profile = read_profile(spark, f"{where}/profile", set(FEATURES))
    im = emb(spark, sf_dir)
    told = with_scores(im.wanted(["area", "anisometry", "k_factor", "convexity", "roundness", "sides"]), profile)
    write_csv(told, f"{where}/csv")
    im.release()
    return rounded(flat(read_csv(spark, f"{where}/csv", told.schema)))


def _bitmap_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masks written as bitmap files, read again, and run-length encoded."""
    where = fresh(spark, "bitmaps")
    write_bitmaps(emb_runs(spark, sf_dir), where, EMB_WIDTH, EMB_HEIGHT)
    return rounded(runs_of(spark.read.format("bitmap").load(where), EMB_WIDTH))


def scattered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the embedding images (image_id, r, runs in order, none in empty rows), spread by hash over as many tasks as shuffles have."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id IS NOT NULL")
    every = vectors.select(F.floor(F.col("vec_id") / EMB_WIDTH).alias("image_id"), F.pmod("vec_id", F.lit(EMB_WIDTH)).cast("int").alias("r"))
    both = every.unionByName(emb_runs(spark, sf_dir).where("image_id IS NOT NULL").select("image_id", "r", "c0", "c1"), allowMissingColumns=True)
    runs = F.sort_array(F.collect_list(F.when(F.col("c0").isNotNull(), F.struct("c0", "c1"))))  # collect_list leaves out the nulls
    return both.repartition(shuffle_tasks(spark), "image_id", "r").groupBy("image_id", "r").agg(runs.alias("runs"))


def _strip_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the images in scattered order, as a stream of several batches."""
    where = fresh(spark, "strips")
    scattered_rows(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.lit(86_400))).write.parquet(f"{where}/in/0")
    files = len(spark.read.parquet(f"{where}/in/0").inputFiles())
    # a row of another time moves the watermark on
    later = spark.createDataFrame([(-1, 0, [])], "image_id long, r int, runs array<struct<c0:int,c1:int>>").withColumn("ts", F.timestamp_seconds(F.lit(2 * 86_400)))
    later.coalesce(1).write.parquet(f"{where}/in/1")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        stream = spark.readStream.schema(later.schema).option("maxFilesPerTrigger", -(-files // STRIP_BATCHES)).parquet(f"{where}/in/*").withWatermark("ts", "1 minute")
        query = strip_features(stream, EMB_WIDTH).writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return rounded(spark.read.schema(STRIPS).parquet(f"{where}/out"))


#: Rules that name every feature of the three processes.
PROCESS_RULES = [
    ("coater", "pinhole", [("circularity", 0.7, 1), ("area", 1, 4)]),
    ("coater", "uncoated", [("area", 60, INF)]),
    ("coater", "tear", [("convexity", 0, 0.6)]),
    ("coater", "bubbles", [("holes", 1, INF), ("euler", -INF, 0)]),
    ("roll_press", "wrinkle", [("anisometry", 3, INF), ("orientation", -1, 1)]),
    ("roll_press", "crack", [("anisometry", 4, INF)]),
    ("roll_press", "pressed_in", [("rectangularity", 0.9, 1)]),
    ("slitter", "burr", [("roundness", 0, 0.5), ("sides", 0, 3)]),
    ("slitter", "bad_cut", [("contlength_by_diameter", 2.5, INF)]),
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "q01_runs": _of(lambda im: im.runs),
    "q02_links": _of(lambda im: im.links),
    "q03_regions": _of(lambda im: im.once.select(*KEY, "run_id")),
    "q04_area_center": _features("area", "row", "col"),
    "q05_bbox": _features("r1", "c1", "r2", "c2"),
    "q06_moments": _features("m_rr_origin", "m_cc_origin", "m_rc_origin"),
    "q07_central": _features("mu_rr", "mu_cc", "mu_rc"),
    "q08_inertia": _features("ia", "ib"),
    "q09_elliptic_axis": _features("ra", "rb", "phi"),
    "q10_eccentricity": _features("anisometry", "bulkiness", "structure_factor"),
    "q11_orientation": _of(_orientation),
    "q12_euler_holes": _features("euler", "holes"),
    "q12_image_topology": _of(lambda im: image_topology(im.wanted(["euler"]))),
    "q13_runlength": _features("runs", "k_factor"),
    "q14_area_holes": _of(_area_holes),
    "q15_contlength": _figures("contour"),
    "q16_compactness": _features("compactness"),
    "q17_roundness": _of(lambda im: im.figures("roundness").where("distance IS NOT NULL")),
    "q18_circularity": _of(_circularity),
    "q19_diameter": _figures("diameter"),
    "q20_convexity": _of(_convexity),
    "q21_rect2": _figures("rect2"),
    "q22_rectangularity": _features("rectangularity", "aspect_ratio", "fill_ratio"),
    "q23_inner_circle": _figures("inner_circle"),
    "q24_inner_rectangle": _figures("inner_rect"),
    "q25_smallest_circle": _figures("circle"),
    "q26_in_out_ratio": _features("in_out_ratio"),
    "q27_hu": _features("h1", "h2", "h3", "h4", "h5", "h6", "h7"),
    "q28_select_and": _of(_staged_select),
    "q29_select_or": _of(_select_or),
    "q30_scores": _of(_scores),
    "q31_defect_codes": _of(_staged_codes(RULES)),
    "q32_feature_vectors": _of(lambda im: im.features.select("*", *[F.col("hu")[i].alias(f"hu_{i + 1}") for i in range(7)]).drop("hu")),
    "q33_li_runs": _li_runs,
    "q34_li_regions": _li_regions,
    "q35_process_codes": _of(_staged_codes(PROCESS_RULES)),
    "q36_outer_contour": _of(_outer_contour),
    "q37_chain_length": _of(_chain_length),
    "q38_scored_vectors": _scored_vectors,
    "q39_bitmap_runs": _bitmap_runs,
    "q40_strip_stream": _strip_stream,
}
