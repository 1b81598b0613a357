"""The feature vector of every region of a set of images."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import banded, shape
from ..functions.geometry import geometry
from ..functions.shape import KEY
from ..operators.outline import outer_contour
from ..operators.regions import band_rows_of, links_of, regions_of, runs_of

#: Every feature that profiles and selections may name, in the order of the feature vector.
FEATURES = [
    "area", "row", "col", "area_holes", "contlength", "diameter", "circularity", "compactness", "convexity", "rectangularity",
    "distance", "sigma", "roundness", "sides", "ra", "rb", "phi", "anisometry", "bulkiness", "structure_factor", "orientation",
    "r1", "c1", "r2", "c2", "rect2_row", "rect2_col", "rect2_phi", "rect2_long", "rect2_short", "circle_row", "circle_col", "circle_radius",
    "inner_row", "inner_col", "inner_radius", "inner_r1", "inner_c1", "inner_r2", "inner_c2", "aspect_ratio", "fill_ratio", "in_out_ratio",
    "m_rr_origin", "m_cc_origin", "m_rc_origin", "mu_rr", "mu_cc", "mu_rc", "ia", "ib", "h1", "h2", "h3", "h4", "h5", "h6", "h7",
    "components", "holes", "euler", "runs", "k_factor", "contlength_by_diameter",
]


#: Features that need more than the sums: the families of figures of each, and whether the farthest pixel.
NEEDS: dict[str, list[str]] = {
    "area_holes": ["fill"], "contlength": ["contour"], "diameter": ["diameter"], "compactness": ["contour"], "convexity": ["hull"], "rectangularity": ["rect2"],
    "distance": ["roundness"], "sigma": ["roundness"], "roundness": ["roundness"], "sides": ["roundness"],
    "rect2_row": ["rect2"], "rect2_col": ["rect2"], "rect2_phi": ["rect2"], "rect2_long": ["rect2"], "rect2_short": ["rect2"],
    "circle_row": ["circle"], "circle_col": ["circle"], "circle_radius": ["circle"], "inner_row": ["inner_circle"], "inner_col": ["inner_circle"], "inner_radius": ["inner_circle"],
    "inner_r1": ["inner_rect"], "inner_c1": ["inner_rect"], "inner_r2": ["inner_rect"], "inner_c2": ["inner_rect"],
    "aspect_ratio": ["rect2"], "fill_ratio": ["rect2"], "in_out_ratio": ["inner_circle", "circle"],
    "holes": ["links"], "euler": ["links"], "contlength_by_diameter": ["contour", "diameter"],
}
#: Those of them that take sums as well.
OF_SUMS = ("area_holes", "compactness", "convexity", "rectangularity", "fill_ratio", "holes", "euler")
FAR = ("circularity", "orientation")
SUMMED = ("ra", "rb", "phi", "anisometry", "bulkiness", "structure_factor", "row", "col", *(f"m_{k}_origin" for k in ("rr", "cc", "rc")), *(f"mu_{k}" for k in ("rr", "cc", "rc")), "ia", "ib", *(f"h{i}" for i in range(1, 8)), "hu", *FAR)


@dataclass
class Images:
    """The stages from pixels, or ``given`` runs, to features; a stage that no result needs is not planned.

    ``width`` exceeds every column.  Images are taken in bands of ``band_rows`` rows; by default as many as keep a
    band's pixels in memory.  ``height``, if told, is at least the number of rows, counted from 0: images of one band then
    need no seams, and their regions go through kernels whole.  Other regions go through them band by band.
    What several parts read is kept (in memory or on disk); ``release`` lets go of it.
    """

    pixels: DataFrame | None
    width: int
    height: int | None = None
    given: DataFrame | None = None
    band_rows: int = 0
    _kept: list[DataFrame] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.band_rows = self.band_rows or band_rows_of(self.width)

    @property
    def one_band(self) -> bool:
        return self.height is not None and self.height <= self.band_rows

    def keep(self, df: DataFrame) -> DataFrame:
        self._kept.append(df.persist())
        return self._kept[-1]

    def release(self) -> None:
        while self._kept:
            self._kept.pop().unpersist()
        for part in ("regions", "moments", "once"):
            self.__dict__.pop(part, None)

    @cached_property
    def runs(self) -> DataFrame:
        return runs_of(self.pixels, self.width) if self.given is None else self.given

    @cached_property
    def once(self) -> DataFrame:
        """The regions, for a result that reads them once."""
        return regions_of(self.runs, height=self.height, band_rows=self.band_rows, keep=self.keep)

    @cached_property
    def regions(self) -> DataFrame:
        return self.keep(self.once)

    def of(self, keys: DataFrame) -> Images:
        """The same images with only the regions of ``keys`` (image_id, region_id)."""
        some = Images(self.pixels, self.width, self.height, self.given, self.band_rows, self._kept)
        some.__dict__["regions"] = self.regions.join(keys, KEY, "left_semi")
        return some

    @cached_property
    def contour(self) -> DataFrame:
        """The points of each region's outer contour in order."""
        return outer_contour(self.regions, self.width, self.band_rows, one_band=self.one_band, keep=self.keep)

    @cached_property
    def links(self) -> DataFrame:
        return links_of(self.regions)

    @cached_property
    def base(self) -> DataFrame:
        return shape.region_base(self.regions)

    @cached_property
    def moments(self) -> DataFrame:
        return self.keep(shape.moments(self.base))

    @cached_property
    def far(self) -> DataFrame:
        return shape.farthest(self.regions, self.moments)

    def geometry(self, regions: DataFrame, families: list[str]) -> DataFrame:
        if self.one_band:
            return geometry(regions, families)
        return banded.geometry(regions, families, self.band_rows, self.width, self.keep)

    def figures(self, *families: str) -> DataFrame:
        """The columns of ``families`` alone."""
        return self.geometry(self.once if self.one_band else self.regions, list(families))

    @cached_property
    def made(self) -> dict[str, Column]:
        """Features that are made from the figures of families and sums."""
        rect_area = 4 * F.col("rect2_long") * F.col("rect2_short")
        return {
            "area_holes": F.col("filled_area") - F.col("area"),
            "circularity": shape.circularity(),
            "compactness": F.col("contlength") * F.col("contlength") / (4 * F.pi() * F.col("area")),
            "convexity": F.col("area") / F.col("hull_area"),
            "rectangularity": F.col("area") / rect_area,
            "orientation": shape.orientation(),
            "aspect_ratio": F.try_divide("rect2_long", "rect2_short"),
            "fill_ratio": F.col("area") / rect_area,
            "in_out_ratio": F.try_divide("inner_radius", "circle_radius"),
            "components": F.lit(1).cast("long"),
            "euler": F.col("runs") - F.col("links"),
            "holes": 1 - F.col("runs") + F.col("links"),
            "k_factor": F.col("runs") / F.sqrt("area"),
            "contlength_by_diameter": F.try_divide("contlength", "diameter"),
        }

    def wanted(self, names: list[str]) -> DataFrame:
        """image_id, region_id and the features ``names``, a row per region; only what they need is planned."""
        if unknown := [n for n in names if n not in FEATURES and n != "hu"]:
            raise ValueError(f"no such feature: {', '.join(unknown)}")
        names = list(dict.fromkeys(names))
        if not names:
            return self.regions.select(*KEY).distinct()
        families = list(dict.fromkeys(f for n in names for f in NEEDS.get(n, [])))
        if families and all(n in NEEDS and n not in OF_SUMS for n in names):  # nothing of the sums is wanted
            wide = self.geometry(self.regions, families)
            return wide.select(*KEY, *[self.made[n].alias(n) if n in self.made else F.col(n) for n in names])
        wide = self.base if not any(n in SUMMED for n in names) else shape.eccentricity(shape.invariants(self.moments))
        if any(n in FAR for n in names):
            wide = wide.join(self.far, KEY)
        if families:
            wide = wide.join(self.geometry(self.regions, families), KEY)
        return wide.select(*KEY, *[self.made[n].alias(n) if n in self.made else F.col(n) for n in names])

    @cached_property
    def features(self) -> DataFrame:
        """image_id, region_id, FEATURES and the vector ``hu``, a row per region."""
        return self.wanted([*FEATURES, "hu"])


def image_topology(regions: DataFrame) -> DataFrame:
    """components, holes and euler of each image, from the euler number of its regions."""
    out = regions.groupBy("image_id").agg(F.count("*").alias("components"), F.sum("euler").alias("euler"))
    return out.withColumn("holes", F.col("components") - F.col("euler"))
