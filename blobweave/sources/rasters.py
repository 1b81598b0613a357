"""Masks as foreground pixels: ``pixels(image_id BIGINT, r INT, c INT)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Row stride of run numbers; a run's number is row * WIDTH + first column.
EMB_WIDTH = 64
LI_WIDTH = 256
#: Rows of an image.
EMB_HEIGHT = 64
LI_HEIGHT = 256
THRESHOLD = 0.05


def threshold_arrays(rows: DataFrame, image: Column, r: Column, values: Column, least: float) -> DataFrame:
    """Pixels where an array of values, a row of an image, exceeds ``least``."""
    wide = rows.select(image.cast("long").alias("image_id"), r.cast("int").alias("r"), F.posexplode(values).alias("c", "v"))
    return wide.where(F.col("v").cast("double") > least).select("image_id", "r", "c")


def array_runs(rows: DataFrame, image: Column, r: Column, values: Column, least: float, width: int, begin: Column | None = None) -> DataFrame:
    """Maximal runs (image_id, run_id, r, c0, c1) where an array of values exceeds ``least``, found within the scan.

    An array is a row of an image, each row once; or, with ``begin``, the piece of a row that starts at that column.
    Then runs that end at a seam between pieces are put together; only those are shuffled.
    """
    on = F.transform(values, lambda v: F.coalesce(v.cast("double") > least, F.lit(False)))
    wide = rows.select(image.cast("long").alias("image_id"), r.cast("int").alias("r"), (F.lit(0) if begin is None else begin).cast("int").alias("_b"), on.alias("_m")).where("size(_m) > 0")
    place = F.expr("sequence(0, size(_m) - 1)")
    starts = F.filter(place, lambda i: F.expr("_m")[i] & ((i == 0) | ~F.coalesce(F.expr("_m")[F.greatest(i - 1, F.lit(0))], F.lit(False))))
    ends = F.filter(place, lambda i: F.expr("_m")[i] & ((i == F.size("_m") - 1) | ~F.expr("_m")[F.least(i + 1, F.size("_m") - 1)]))
    both = wide.select("image_id", "r", "_b", (F.col("_b") + F.size("_m") - 1).alias("_e"), F.explode(F.arrays_zip(starts.alias("s"), ends.alias("e"))).alias("x"))
    runs = both.select("image_id", "r", "_b", "_e", (F.col("_b") + F.col("x.s")).alias("c0"), (F.col("_b") + F.col("x.e")).alias("c1"))
    if begin is not None:
        at_seam = (F.col("c0") == F.col("_b")) | (F.col("c1") == F.col("_e"))
        row = W.partitionBy("image_id", "r").orderBy("c0")
        seams = runs.where(at_seam).withColumn("_new", F.when(F.col("c0") == F.lag("c1").over(row) + 1, 0).otherwise(1)).withColumn("_g", F.sum("_new").over(row))
        whole = seams.groupBy("image_id", "r", "_g").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1"))
        runs = runs.where(~at_seam).select("image_id", "r", "c0", "c1").unionByName(whole.select("image_id", "r", "c0", "c1"))
    return runs.select("image_id", (F.col("r").cast("long") * width + F.col("c0")).alias("run_id"), "r", "c0", "c1")


def emb_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of ``emb_pixels``, without making pixels."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return array_runs(rows, F.floor(F.col("vec_id") / EMB_WIDTH), F.pmod("vec_id", F.lit(EMB_WIDTH)), F.col("embedding"), THRESHOLD, EMB_WIDTH)


def emb_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 vectors to an image, a vector to a row."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return threshold_arrays(rows, F.floor(F.col("vec_id") / EMB_WIDTH), F.pmod("vec_id", F.lit(EMB_WIDTH)), F.col("embedding"), THRESHOLD)


def li_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image for each return flag and line status; part number by fortnight of shipping.  Pixels come more than once."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    image = F.ascii("l_returnflag") * 256 + F.ascii("l_linestatus")
    c = F.floor(F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")) / 14)
    return rows.select(image.cast("long").alias("image_id"), F.pmod("l_partkey", F.lit(LI_WIDTH)).cast("int").alias("r"), c.cast("int").alias("c"))


def mask_pixels(spark: SparkSession, masks: dict[int, list[str]]) -> DataFrame:
    """Pixels of drawn masks: rows of text in which # is foreground."""
    rows = [(i, r, c) for i, mask in masks.items() for r, line in enumerate(mask) for c, x in enumerate(line) if x == "#"]
    return spark.createDataFrame(rows, "image_id long, r int, c int")
