"""Features that are sums, extremes and closed forms over runs."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["image_id", "region_id"]
SUM = "decimal(38,0)"


def _n(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def region_base(regions: DataFrame) -> DataFrame:
    """Exact integer sums of each region: area, first to third moments about the middle of its box (o_r, o_c), box, runs.

    One aggregate: sums are taken about the image's origin and moved to the box's middle afterwards, both exactly.  Coordinates
    are those of images of up to a million rows and columns.
    """
    y, a, b = F.col("r").cast("long"), F.col("c0").cast("long"), F.col("c1").cast("long")
    n = b - a + 1
    x2 = F.expr("(_b * (_b + 1) * (2 * _b + 1)) div 6 - ((_a - 1) * _a * (2 * _a - 1)) div 6")
    # twice the sum of columns, and that of squares; the sum of cubes is the difference of squares of triangular numbers
    terms = regions.select(*KEY, y.alias("_y"), a.alias("_a"), b.alias("_b"), n.alias("_n"), ((a + b) * n).alias("_x1")).select("*", F.expr("_x1 div 2").alias("x1"), x2.alias("x2"))
    big = {c: F.col(c).cast("decimal(19,0)") for c in ("_y", "_n", "x1", "x2")}
    triangle = [F.expr(t).cast("decimal(19,0)") for t in ("(_b * (_b + 1)) div 2 - ((_a - 1) * _a) div 2", "(_b * (_b + 1)) div 2 + ((_a - 1) * _a) div 2")]

    def total(c: Column, name: str) -> Column:
        return F.sum(c.cast("decimal(28,0)")).cast(SUM).alias(name)

    yy = (F.col("_y") * F.col("_y")).cast("decimal(14,0)")
    sums = terms.groupBy(*KEY).agg(
        F.sum("_n").alias("area"), F.count("*").alias("runs"), F.min("_y").cast("int").alias("r1"), F.min("_a").cast("int").alias("c1"), F.max("_y").cast("int").alias("r2"), F.max("_b").cast("int").alias("c2"),
        total(F.col("_y") * F.col("_n"), "t_r"), total(F.col("x1"), "t_c"), total(F.col("_y") * F.col("_y") * F.col("_n"), "t_rr"), total(F.col("x2"), "t_cc"), total(F.col("_y") * F.col("x1"), "t_rc"),
        total(yy * (F.col("_y") * F.col("_n")).cast("decimal(14,0)"), "t_rrr"), total(yy * F.col("x1").cast("decimal(14,0)"), "t_rrc"), total(F.col("_y").cast("decimal(7,0)") * big["x2"], "t_rcc"), total(triangle[0] * triangle[1], "t_ccc"),
    )
    sums = sums.withColumns({"o_r": F.expr("(CAST(r1 AS LONG) + r2) div 2"), "o_c": F.expr("(CAST(c1 AS LONG) + c2) div 2")})
    moved = {
        "s_r": "t_r - p * n", "s_c": "t_c - q * n", "s_rr": "t_rr - 2 * p * t_r + p * p * n", "s_cc": "t_cc - 2 * q * t_c + q * q * n", "s_rc": "t_rc - p * t_c - q * t_r + p * q * n",
        "s_rrr": "t_rrr - 3 * p * t_rr + 3 * p * p * t_r - p * p * p * n", "s_ccc": "t_ccc - 3 * q * t_cc + 3 * q * q * t_c - q * q * q * n",
        "s_rrc": "t_rrc - 2 * p * t_rc + p * p * t_c - q * t_rr + 2 * p * q * t_r - p * p * q * n", "s_rcc": "t_rcc - 2 * q * t_rc + q * q * t_r - p * t_cc + 2 * p * q * t_c - p * q * q * n",
    }
    # decimal products are cut back to 38 digits term by term
    out = sums.withColumns({"_p": F.col("o_r").cast(SUM), "_q": F.col("o_c").cast(SUM), "_n": F.col("area").cast(SUM)})
    return out.withColumns({k: _exact(v) for k, v in moved.items()}).drop("_p", "_q", "_n", *[c for c in sums.columns if c.startswith("t_")])


def _exact(sum_of_products: str) -> Column:
    """A sum of products of whole numbers as decimal(38,0), each partial product cut to 38 digits; raises on overflow."""
    out = None
    for sign, term in re.findall(r"([+-]?) ?([^+-]+)", sum_of_products):
        product = None
        for f in term.strip().split(" * "):
            one = F.lit(int(f)).cast(SUM) if f.isdigit() else F.col({"p": "_p", "q": "_q", "n": "_n"}.get(f, f))
            product = one if product is None else (product * one).cast(SUM)
        out = product if out is None else (out - product if sign == "-" else out + product).cast(SUM)
    return out


#: Products of sums are exact for boxes of less than this many rows and columns; beyond, they are taken in double precision about the box's middle.
EXACT_BOX = 20_000


def _large() -> Column:
    return F.greatest(F.col("r2") - F.col("r1"), F.col("c2") - F.col("c1")) >= EXACT_BOX


def _over(numerator: Column, *areas: Column) -> Column:
    out = numerator.cast("double")
    for a in areas:
        out = out / a
    return out


def moments(base: DataFrame) -> DataFrame:
    """Adds centre (row, col), origin moments, central moments by area, and the ellipse."""
    a, sr, sc = _n("area"), _n("s_r"), _n("s_c")
    area = F.col("area").cast("double")
    r1, c1 = _n("o_r"), _n("o_c")

    def mean(k: str) -> Column:
        return F.col(f"s_{k}").cast("double") / area

    def second(k: str, x: str, y: str) -> Column:
        exact = _over(a * _n(f"s_{k}") - _n(f"s_{x}") * _n(f"s_{y}"), area, area)
        return F.when(_large(), mean(k) - mean(x) * mean(y)).otherwise(exact)

    out = base.withColumns({
        "row": F.col("o_r") + F.col("s_r").cast("double") / area,
        "col": F.col("o_c") + F.col("s_c").cast("double") / area,
        "m_rr_origin": (F.col("s_rr") + 2 * r1 * sr + r1 * r1 * a).cast(SUM),
        "m_cc_origin": (F.col("s_cc") + 2 * c1 * sc + c1 * c1 * a).cast(SUM),
        "m_rc_origin": (F.col("s_rc") + r1 * sc + c1 * sr + r1 * c1 * a).cast(SUM),
        "mu_rr": second("rr", "r", "r"), "mu_cc": second("cc", "c", "c"), "mu_rc": second("rc", "r", "c"),
    })
    root = F.sqrt(F.pow(F.col("mu_rr") - F.col("mu_cc"), F.lit(2.0)) + 4 * F.col("mu_rc") * F.col("mu_rc"))
    out = out.withColumn("_root", root)
    trace = F.col("mu_rr") + F.col("mu_cc")
    out = out.withColumns({
        "ia": (trace + F.col("_root")) / 2,
        "ib": F.greatest(F.lit(0.0), (trace - F.col("_root")) / 2),
        "ra": F.sqrt(2 * (trace + F.col("_root"))),
    })
    # a line has no width; what rounding leaves of it is no width either
    thin = F.col("mu_rr") * F.col("mu_cc") - F.col("mu_rc") * F.col("mu_rc") <= 1e-12 * F.greatest(F.lit(1.0), trace * trace)
    out = out.withColumn("rb", F.when(thin, F.lit(0.0)).otherwise(F.sqrt(F.greatest(F.lit(0.0), 2 * (trace - F.col("_root"))))))
    phi = -0.5 * F.atan2(2 * F.col("mu_rc"), F.col("mu_cc") - F.col("mu_rr"))
    return out.withColumn("phi", F.when(phi <= -math.pi / 2, phi + math.pi).otherwise(phi)).drop("_root")


def eccentricity(m: DataFrame) -> DataFrame:
    """Adds anisometry, bulkiness and structure_factor to ``moments``."""
    ani = F.when(F.col("rb") > 0, F.col("ra") / F.col("rb")).when(F.col("ra") > 0, F.lit(float("inf")))
    bulk = F.pi() * F.col("ra") * F.col("rb") / F.col("area")
    out = m.withColumn("anisometry", ani).withColumn("bulkiness", bulk)
    return out.withColumn("structure_factor", F.when(F.col("rb") > 0, F.col("anisometry") * F.col("bulkiness") - 1))


def farthest(regions: DataFrame, m: DataFrame) -> DataFrame:
    """(key, far_r, far_c, max_distance): the pixel farthest from the centre, the first in (r, c) of several.

    It is an end of a run.  Distances are compared exactly, scaled by the area.
    """
    ends = regions.select(*KEY, "r", F.explode(F.array("c0", "c1")).alias("c"))
    met = ends.join(m.select(*KEY, "area", "s_r", "s_c", "o_r", "o_c"), KEY)
    dr = _n("area") * (F.col("r") - F.col("o_r")).cast("decimal(10,0)") - F.col("s_r")
    dc = _n("area") * (F.col("c") - F.col("o_c")).cast("decimal(10,0)") - F.col("s_c")
    d2 = (dr.cast("decimal(19,0)") * dr.cast("decimal(19,0)") + dc.cast("decimal(19,0)") * dc.cast("decimal(19,0)")).cast(SUM)
    top = F.max_by(F.struct("r", "c"), F.struct("_d2", -F.col("r"), -F.col("c"))).alias("_p")
    best = met.withColumn("_d2", d2).groupBy(*KEY, "area").agg(top, F.max("_d2").alias("_d2"))
    return best.select(*KEY, F.col("_p.r").alias("far_r"), F.col("_p.c").alias("far_c"), (F.sqrt(F.col("_d2").cast("double")) / F.col("area")).alias("max_distance"))


def circularity() -> Column:
    """Area over that of the disc to the farthest pixel; needs area and max_distance."""
    disc = F.pi() * F.col("max_distance") * F.col("max_distance")
    return F.when(F.col("max_distance") > 0, F.least(F.lit(1.0), F.col("area") / disc))


def orientation() -> Column:
    """phi turned towards the farthest pixel; needs phi, row, col, far_r, far_c."""
    along = (F.col("far_c") - F.col("col")) * F.cos("phi") - (F.col("far_r") - F.col("row")) * F.sin("phi")
    turned = F.when(F.col("phi") > 0, F.col("phi") - math.pi).otherwise(F.col("phi") + math.pi)
    return F.when(along < -1e-9, turned).otherwise(F.col("phi"))


def invariants(m: DataFrame) -> DataFrame:
    """Adds h1..h7, Hu's invariants, and ``hu``, the vector of them."""
    a, sr, sc = _n("area"), F.col("s_r"), F.col("s_c")
    area = F.col("area").cast("double")
    s = {k: F.col(f"s_{k}") for k in ("rr", "cc", "rc", "rrr", "rrc", "rcc", "ccc")}

    def d(c: Column) -> Column:
        return c.cast(SUM)

    third = {
        "30": d(d(a * a) * s["rrr"]) - d(3 * d(a * sr) * s["rr"]) + d(2 * d(sr * sr) * sr),
        "03": d(d(a * a) * s["ccc"]) - d(3 * d(a * sc) * s["cc"]) + d(2 * d(sc * sc) * sc),
        "21": d(d(a * a) * s["rrc"]) - d(d(a * sc) * s["rr"]) - d(2 * d(a * sr) * s["rc"]) + d(2 * d(sr * sr) * sc),
        "12": d(d(a * a) * s["rcc"]) - d(d(a * sr) * s["cc"]) - d(2 * d(a * sc) * s["rc"]) + d(2 * d(sc * sc) * sr),
    }
    scale = F.pow(area, F.lit(4.5))

    def about(k: str, x: str, y: str, z: str) -> Column:  # the third central moment of x, y and z over the area to the 1.5
        mean = {n: F.col(f"s_{n}").cast("double") / area for n in ("r", "c", "rr", "cc", "rc", k)}
        pair = lambda p, q: mean["".join(sorted(p + q, reverse=True))]
        return (mean[k] - mean[x] * pair(y, z) - mean[y] * pair(x, z) - mean[z] * pair(x, y) + 2 * mean[x] * mean[y] * mean[z]) / F.pow(area, F.lit(1.5))

    rounded = {"30": about("rrr", "r", "r", "r"), "03": about("ccc", "c", "c", "c"), "21": about("rrc", "r", "r", "c"), "12": about("rcc", "r", "c", "c")}
    out = m.withColumns({f"_e{k}": F.when(_large(), rounded[k]).otherwise(v.cast("double") / scale) for k, v in third.items()})
    out = out.withColumns({"_e20": F.col("mu_rr") / area, "_e02": F.col("mu_cc") / area, "_e11": F.col("mu_rc") / area})
    e20, e02, e11, e30, e03, e21, e12 = (F.col(f"_e{k}") for k in ("20", "02", "11", "30", "03", "21", "12"))
    p, q, u, v = e30 + e12, e21 + e03, e30 - 3 * e12, 3 * e21 - e03
    h = {
        "h1": e20 + e02,
        "h2": (e20 - e02) * (e20 - e02) + 4 * e11 * e11,
        "h3": u * u + v * v,
        "h4": p * p + q * q,
        "h5": u * p * (p * p - 3 * q * q) + v * q * (3 * p * p - q * q),
        "h6": (e20 - e02) * (p * p - q * q) + 4 * e11 * p * q,
        "h7": v * p * (p * p - 3 * q * q) - u * q * (3 * p * p - q * q),
    }
    out = out.withColumns(h).drop(*[f"_e{k}" for k in ("20", "02", "11", "30", "03", "21", "12")])
    return out.withColumn("hu", F.array(*h))
