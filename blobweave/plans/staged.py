"""Selections and rules in stages: cheap features decide first which regions the costly ones are found for.

Features that are sums or extremes over runs come from one aggregate.  Those that need kernels are
found family group by family group, the cheaper first, and only for regions that some rule
can still apply to: their runs are reduced by a semi-join before the kernel.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.choose import RULES, defect_codes
from .features import FAR, FEATURES, KEY, NEEDS, Images

#: Families by what they cost, the cheapest first; those of a group share a pass over the runs.
GROUPS = (("far",), ("links",), ("hull", "diameter", "rect2", "circle"), ("fill", "contour", "roundness"), ("inner_rect", "inner_circle"))
#: Rules that are planned one by one; a larger set is applied to whole feature vectors.
RULES_PLANNED = 200


def group_of(name: str) -> int:
    """The stage in which a feature is known: 0 for sums, then the last of the groups that it needs."""
    families = NEEDS.get(name, []) + ["far"] * (name in FAR)
    return max((1 + next(i for i, g in enumerate(GROUPS) if f in g) for f in families), default=0)


def _inside(name: str, lo: float, hi: float) -> Column:
    return F.coalesce(F.col(name).cast("double").between(lo, hi), F.lit(False))


def known(images: Images, rules: list[list[tuple[str, float, float]]], also: list[str] | None = None) -> DataFrame:
    """The features that ``rules`` (lists of (feature, lo, hi), all of which must hold) name, of the regions that some rule may apply to.

    A feature is null where no rule that names it can apply any more.  Those of ``also`` are found for all that are left at the end.
    """
    also = [n for n in also or [] if n not in {f for rule in rules for f, _, _ in rule}]
    if unknown := [f for rule in rules for f, _, _ in rule if f not in FEATURES] + [n for n in also if n not in FEATURES]:
        raise ValueError(f"no such feature: {', '.join(unknown)}")
    stages: dict[int, list[str]] = defaultdict(list)
    for name in dict.fromkeys(f for rule in rules for f, _, _ in rule):
        stages[group_of(name)].append(name)
    found = images.wanted(stages.pop(0, []))
    done: list[str] = [n for n in found.columns if n not in KEY]

    def open_(rule: list[tuple[str, float, float]]) -> Column:
        """Whether the conditions hold that can be told by now."""
        return reduce(and_, [_inside(*x) for x in rule if x[0] in done], F.lit(True))

    for stage in sorted(stages):
        # read twice in each stage: not kept, the first stages would be done anew for each of the later ones, twice as often from one to the next
        found = images.keep(found.where(reduce(or_, map(open_, rules), F.lit(False))))
        names = stages[stage]
        due = found.where(reduce(or_, [open_(rule) for rule in rules if any(f in names for f, _, _ in rule)]))
        found = found.join(images.of(due.select(*KEY)).wanted(names), KEY, "left")
        done += names
    found = found.where(reduce(or_, map(open_, rules), F.lit(False)))
    if not also:
        return found
    found = images.keep(found)
    return found.join(images.of(found.select(*KEY)).wanted(also), KEY)


def selected(images: Images, names: list[str], least: list[float], most: list[float]) -> DataFrame:
    """``select_shape`` of the features ``names`` by all their intervals, with those features, in stages."""
    if not len(names) == len(least) == len(most):
        raise ValueError("names, least and most differ in length")
    return known(images, [list(zip(names, least, most, strict=True))]).select(*KEY, *names)


def codes(images: Images, rules: DataFrame, priority: dict[str, int] | None = None) -> DataFrame:
    """``defect_codes`` of the regions of ``images`` by ``rules`` (process, code, feature, lo, hi, n_conditions), in stages."""
    rows = rules.collect()
    by: dict[tuple[str, str], list[tuple[str, float, float]]] = defaultdict(list)
    for r in rows:
        by[r["process"], r["code"]].append((r["feature"], r["lo"], r["hi"]))
    if not rows:
        return images.runs.sparkSession.createDataFrame([], "image_id long, region_id long, process string, code string")
    if len(by) > RULES_PLANNED:
        return defect_codes(images.wanted(sorted({r["feature"] for r in rows})), rules, priority)
    return defect_codes(known(images, list(by.values())), images.runs.sparkSession.createDataFrame(rows, RULES), priority)
