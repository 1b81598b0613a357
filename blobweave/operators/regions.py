"""From pixels to regions: runs, 8-connected components, run links, filling.

A region is kept as its runs ``(image_id, region_id, run_id, r, c0, c1)``, last
column included; its number is that of its top-left run.  Components are found by
union-find per band of rows; labels that touch across a seam between bands are then
contracted (``contract``).  A task holds one band of an image, whose rows are as
many as its pixels allow, so neither an image nor a region is ever in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .contract import joined, roots_of

BAND_ROWS = 4096
#: Pixels of a band at most, unless a single row has more.
BAND_PIXELS = BAND_ROWS * BAND_ROWS
#: Rows of results that a kernel gathers before it passes them on.
ROWS_OUT = 5000
RUNS = "image_id long, region_id long, run_id long, r int, c0 int, c1 int"


def band_rows_of(width: int) -> int:
    """Rows of a band of images of ``width`` columns."""
    return max(1, BAND_PIXELS // width)


def shuffle_tasks(spark: SparkSession) -> int:
    """Tasks of a shuffle before costly work: given as a number, adaptive plans don't put small partitions together."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def runs_of(pixels: DataFrame, width: int) -> DataFrame:
    """Maximal horizontal runs (image_id, run_id, r, c0, c1) of pixels in any order; repeated pixels count once.

    One aggregate, which combines before the shuffle: the sorted set of the columns of an image's row is cut where it has gaps.
    """
    rows = pixels.groupBy("image_id", "r").agg(F.sort_array(F.collect_set("c")).alias("_c"))
    c = F.col("_c")
    starts = F.filter(c, lambda x, i: (i == 0) | (F.get(c, i - 1) != x - 1))
    ends = F.filter(c, lambda x, i: (i == F.size(c) - 1) | (F.get(c, i + 1) != x + 1))
    runs = rows.select("image_id", "r", F.explode(F.arrays_zip(starts.alias("s"), ends.alias("e"))).alias("x"))
    return runs.select("image_id", (F.col("r").cast("long") * width + F.col("x.s")).alias("run_id"), "r", F.col("x.s").alias("c0"), F.col("x.e").alias("c1"))


def touching(r: np.ndarray, c0: np.ndarray, c1: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of runs in neighbouring rows that touch (``reach`` 1: also at corners); runs sorted by (r, c0)."""
    if not len(r):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    stride = int(c1.max()) - int(c0.min()) + 4
    low = c0.min() - 1
    begins, ends = r * stride + (c0 - low), r * stride + (c1 - low)
    first = np.searchsorted(ends, (r + 1) * stride + (c0 - low) - reach)
    last = np.searchsorted(begins, (r + 1) * stride + (c1 - low) + reach, "right")
    n = np.maximum(last - first, 0)
    a = np.repeat(np.arange(len(r)), n)
    return a, np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _label_band(table: pa.Table) -> pa.Table:
    """The runs of a band of an image with the first run of their component within it."""
    table = table.sort_by([("r", "ascending"), ("c0", "ascending")])
    r, c0, c1 = (table[c].to_numpy().astype(np.int64) for c in ("r", "c0", "c1"))
    top = joined(len(r), *touching(r, c0, c1, 1))
    return table.append_column("label", pa.array(table["run_id"].to_numpy()[top])).select(["image_id", "label", "run_id", "r", "c0", "c1"])


def regions_of(runs: DataFrame, *, band_rows: int = BAND_ROWS, height: int | None = None, keep: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> DataFrame:
    """``runs`` with the ``region_id`` of their 8-connected component (RUNS); no seams are looked for in images of at most ``height`` rows, from 0 on, if that is a band.

    ``keep`` gets the labelled bands, which are costly to make and read several times.
    """
    if height is not None and height <= band_rows:
        return runs.groupBy("image_id").applyInArrow(_label_band, RUNS.replace("region_id", "label")).withColumnRenamed("label", "region_id")
    banded = runs.withColumn("band", F.floor(F.col("r") / band_rows))
    labelled = keep(banded.groupBy("image_id", "band").applyInArrow(_label_band, RUNS.replace("region_id", "label")))
    below = labelled.where(F.pmod("r", F.lit(band_rows)) == 0).alias("b")
    above = labelled.where(F.pmod("r", F.lit(band_rows)) == band_rows - 1).alias("a")
    meets = F.expr("a.image_id = b.image_id AND a.r + 1 = b.r AND b.c0 <= a.c1 + 1 AND b.c1 >= a.c0 - 1")
    seams = above.join(below, meets).select("a.image_id", F.col("a.label").alias("a"), F.col("b.label").alias("b"))
    names = roots_of(seams, ["image_id"])
    whole = labelled.join(names, ["image_id", "label"], "left")
    return whole.select("image_id", F.coalesce("root", "label").alias("region_id"), "run_id", "r", "c0", "c1")


def links_of(regions: DataFrame) -> DataFrame:
    """(image_id, region_id, src, dst): runs that touch in rows r and r + 1."""
    a, b = regions.alias("a"), regions.alias("b")
    on = F.expr("a.image_id = b.image_id AND a.region_id = b.region_id AND a.r + 1 = b.r AND b.c0 <= a.c1 + 1 AND b.c1 >= a.c0 - 1")
    return a.join(b, on).select("a.image_id", "a.region_id", F.col("a.run_id").alias("src"), F.col("b.run_id").alias("dst"))


def by_region(rows: DataFrame, columns: list[str], kernel, schema: str, keys: tuple[str, ...] = ("image_id", "region_id")) -> DataFrame:
    """``kernel(columns as int64 arrays) -> list of tuples`` over each region's rows, sorted by ``columns``.

    Regions stream through sorted partitions, so a task holds one region at a time
    and small regions cost no call of their own across the process boundary.  The
    tuples lack ``keys``, which ``schema`` starts with; a band as a further key makes
    that the part of a region within it.
    """
    fields = pa.schema([(name, {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[kind]) for name, kind in (x.split() for x in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, done = None, [], []

        def out(least: int) -> Iterator[pa.RecordBatch]:
            if held:
                done.extend((*now, *row) for row in kernel(*(np.concatenate(x) for x in zip(*held, strict=True))))
                held.clear()
            if len(done) > least:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), fields.types, strict=True)], schema=fields)
                done.clear()

        for batch in batches:
            marks = [batch[c].to_numpy(zero_copy_only=False) for c in keys]
            values = [batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]
            cuts = np.flatnonzero(np.logical_or.reduce([m[1:] != m[:-1] for m in marks])) + 1
            for i, j in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if j > i:
                    key = tuple(int(m[i]) for m in marks)
                    if key != now:
                        yield from out(ROWS_OUT)
                        now = key
                    held.append([v[i:j] for v in values])
        yield from out(0)

    # by a hash of the keys, as a plan that already deals by the keys would leave a shuffle by them out, and its own may be put together
    return rows.select(*dict.fromkeys([*keys, *columns])).repartition(shuffle_tasks(rows.sparkSession), F.xxhash64(*keys)).sortWithinPartitions(*keys, *columns).mapInArrow(run, schema)


PART = ("image_id", "region_id", "band")


def with_bands(runs: DataFrame, band_rows: int, *, above: bool = True, below: bool = False) -> DataFrame:
    """``runs`` with their ``band``; with ``above`` the last row of each band is in the next one, too, with ``below`` the first in the one before."""
    band, row = F.floor(F.col("r") / band_rows), F.pmod("r", F.lit(band_rows))
    more = [(above, row == band_rows - 1, band + 1), (below, row == 0, band - 1)]
    if not above and not below:
        return runs.withColumn("band", band)
    also = [F.when(at_seam, other) for wanted, at_seam, other in more if wanted]
    return runs.withColumn("band", F.explode(F.array_compact(F.array(band, *also))))


def filled(r: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of a region with its holes filled; runs sorted by (r, c0).

    The background of the box with a margin of one is cut into runs; those that do
    not reach the margin 4-connectedly are holes.
    """
    if (np.diff(r) > 0).all():  # a hole lies between two runs of a row
        return r, c0, c1
    top, bottom, left, right = r.min() - 1, r.max() + 1, c0.min() - 1, c1.max() + 1
    # background runs: from the margin or a run's end to the next run or the margin
    rows = np.concatenate([[top], r, np.flatnonzero(np.bincount(r - r.min())) + r.min(), [bottom]])
    first = np.concatenate([[left], c1 + 1, np.full(len(rows) - len(r) - 2, left), [left]])
    order = np.lexsort((first, rows))
    rows, first = rows[order], first[order]
    last = np.empty_like(first)
    ends_row = np.ones(len(rows), bool)
    ends_row[:-1] = rows[1:] != rows[:-1]
    last[ends_row] = right
    last[~ends_row] = c0 - 1
    label = joined(len(rows), *touching(rows, first, last, 0))
    open_ = np.unique(label[(first == left) | (last == right)])
    hole = ~np.isin(label, open_)
    rr, a, b = np.concatenate([r, rows[hole]]), np.concatenate([c0, first[hole]]), np.concatenate([c1, last[hole]])
    order = np.lexsort((a, rr))
    rr, a, b = rr[order], a[order], b[order]
    new = np.ones(len(rr), bool)
    new[1:] = (rr[1:] != rr[:-1]) | (a[1:] > b[:-1] + 1)
    start = np.flatnonzero(new)
    return rr[start], a[start], np.maximum.reduceat(b, start)


def fill_up(regions: DataFrame, *, band_rows: int | None = None, width: int = 0, keep: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> DataFrame:
    """(image_id, region_id, r, c0, c1) of the regions with their holes filled; with ``band_rows`` no region is in one task."""
    if band_rows:
        pieces = regions.select("image_id", "region_id", "r", "c0", "c1").unionByName(holes_of(regions, band_rows, width, keep))
        row = W.partitionBy("image_id", "region_id", "r").orderBy("c0")
        fresh = F.when(F.col("c0") == F.lag("c1").over(row) + 1, 0).otherwise(1)
        told = pieces.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(row))
        return told.groupBy("image_id", "region_id", "r", "_run").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1")).drop("_run")

    def kernel(r: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> list[tuple]:
        return list(zip(*(x.tolist() for x in filled(r, c0, c1)), strict=True))

    return by_region(regions, ["r", "c0", "c1"], kernel, "image_id long, region_id long, r int, c0 int, c1 int")


def _gaps(band_rows: int, width: int):
    """Kernel over a band of a region and the row above it: (kind, label, r, c0, c1).

    Gaps lie between the runs of a row; those that touch, in rows next to each other,
    share a label: the smallest number of a gap, or OPEN if one of them is next to what
    lies outside of the region.  Kind 0: a gap of the band.  Kind 1: the gap of number c0
    has this label here, for gaps that the next or the previous band knows, too.
    """

    def kernel(band: np.ndarray, r: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> list[tuple]:
        top = int(band[0]) * band_rows - 1  # the row above
        new = np.ones(len(r), bool)
        new[1:] = r[1:] != r[:-1]
        inner = np.flatnonzero(~new)
        row, a, b = r[inner], c1[inner - 1] + 1, c0[inner] - 1
        if not len(row):
            return []
        rows = r[new]
        left, right = c0[new], c1[np.append(np.flatnonzero(new)[1:], len(r)) - 1]

        def exposed(to: np.ndarray) -> np.ndarray:  # to what is beyond the ends of row ``to``
            at = np.minimum(np.searchsorted(rows, to), len(rows) - 1)
            return (rows[at] != to) | (a < left[at]) | (b > right[at])

        # rows r and r + 1 are looked at in the band of r + 1
        open_ = ((row < top + band_rows) & exposed(row + 1)) | ((row > top) & exposed(row - 1))
        label = joined(len(row), *touching(row, a, b, 0))
        number = row * width + a
        name = np.where(np.isin(label, label[open_]), OPEN, number[label])
        own = row > top
        seam = (row == top) | (row == top + band_rows)
        found = [(0, *x) for x in zip(name[own].tolist(), row[own].tolist(), a[own].tolist(), b[own].tolist(), strict=True)]
        return found + [(1, n, 0, g, 0) for n, g in zip(name[seam].tolist(), number[seam].tolist(), strict=True)]

    return kernel


OPEN = -1


def holes_of(regions: DataFrame, band_rows: int, width: int, keep: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> DataFrame:
    """(image_id, region_id, r, c0, c1) of the runs of the holes of regions, band by band; ``width`` exceeds every column.

    ``keep`` gets the labelled gaps, which are read twice.
    """
    told = keep(by_region(with_bands(regions, band_rows), ["band", "r", "c0", "c1"], _gaps(band_rows, width), "image_id long, region_id long, band long, kind int, label long, r int, c0 long, c1 int", PART))
    keys = ["image_id", "region_id"]
    links = told.where("kind = 1").select(*keys, F.col("label").alias("a"), F.col("c0").alias("b"))
    gaps = told.where(f"kind = 0 AND label <> {OPEN}").drop("kind", "band")
    # a label that no other band knows is closed where it is
    named = gaps.join(roots_of(links, keys), [*keys, "label"], "left").where(f"root IS NULL OR root <> {OPEN}")
    return named.select(*keys, "r", F.col("c0").cast("int").alias("c0"), "c1")
