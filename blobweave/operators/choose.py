"""Selecting regions by intervals, scoring features and assigning defect codes."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Profiles and rules are written by people; up to this many rows they are broadcast.
SMALL_ROWS = 100_000
KEY = ["image_id", "region_id"]
RULES = "process string, code string, feature string, lo double, hi double, n_conditions int"


def select_shape(features: DataFrame, names: list[str], least: list[float], most: list[float], how: str = "and") -> DataFrame:
    """Regions whose features lie in closed intervals, all of them (and) or any (or); an undefined value lies in none."""
    if how not in ("and", "or"):
        raise ValueError(f"how is 'and' or 'or', not {how!r}")
    if not len(names) == len(least) == len(most):
        raise ValueError("names, least and most differ in length")
    if unknown := [n for n in names if n not in features.columns]:
        raise ValueError(f"no such feature: {', '.join(unknown)}")
    inside = [F.coalesce(F.col(n).cast("double").between(lo, hi), F.lit(False)) for n, lo, hi in zip(names, least, most, strict=True)]
    return features.where(reduce(and_ if how == "and" else or_, inside, F.lit(how == "and")))


def score(value: Column, v_min: Column, v_max: Column, direction: Column) -> Column:
    """0 to 100 by where ``value`` lies from v_min to v_max, or 100 less that; null if undefined or v_min = v_max."""
    share = F.try_divide(value - v_min, v_max - v_min)
    clamped = F.when(share < 0, 0.0).when(share > 1, 1.0).otherwise(share)
    return F.when(value.isNull() | (v_min == v_max), None).when(direction == "decreasing", 100 - 100 * clamped).otherwise(100 * clamped)


def long_form(features: DataFrame, names: list[str]) -> DataFrame:
    """(key, feature, value) for the features ``names``."""
    made = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])
    pairs = F.explode(made.cast("array<struct<feature:string,value:double>>")).alias("p")
    return features.select(*KEY, pairs).select(*KEY, "p.feature", "p.value")


def _small(table: DataFrame) -> tuple[DataFrame, list[str]]:
    """``table``, broadcast if it is small, and the features it names."""
    rows = [r["feature"] for r in table.select("feature").distinct().collect()]
    return (F.broadcast(table) if table.count() <= SMALL_ROWS else table), sorted(rows)


def scores(features: DataFrame, profile: DataFrame) -> DataFrame:
    """(image_id, region_id, process, feature, score) for each row of ``profile``."""
    near, names = _small(profile)
    met = long_form(features, names).join(near, "feature")
    return met.select(*KEY, "process", "feature", score(F.col("value"), F.col("v_min"), F.col("v_max"), F.col("direction")).alias("score"))


def with_scores(features: DataFrame, profile: DataFrame) -> DataFrame:
    """``features`` with a struct for each process of ``profile``: the scores of the features that it names.

    A row stays a row and nothing is shuffled; profiles of more than SMALL_ROWS rows are refused.
    """
    rows = profile.orderBy("process", "feature").limit(SMALL_ROWS + 1).collect()
    if len(rows) > SMALL_ROWS:
        raise ValueError(f"a profile of more than {SMALL_ROWS} rows: use scores()")
    by: dict[str, list[Column]] = {}
    for r in rows:
        told = score(F.col(r["feature"]).cast("double"), F.lit(r["v_min"]), F.lit(r["v_max"]), F.lit(r["direction"]))
        by.setdefault(r["process"], []).append(told.alias(r["feature"]))
    if clash := sorted(set(by) & set(features.columns)):
        raise ValueError(f"a process is named as a feature: {', '.join(clash)}")
    return features.select("*", *[F.struct(*fields).alias(process) for process, fields in by.items()])


def rule_rows(spark: SparkSession, rules: list[tuple[str, str, list[tuple[str, float, float]]]]) -> DataFrame:
    """The rule table of (process, code, [(feature, lo, hi), ...])."""
    rows = [(p, code, f, float(lo), float(hi), len(conditions)) for p, code, conditions in rules for f, lo, hi in conditions]
    return spark.createDataFrame(rows, RULES)


def defect_codes(features: DataFrame, rules: DataFrame, priority: dict[str, int] | None = None) -> DataFrame:
    """(image_id, region_id, process, code) of every code all of whose conditions hold.

    With ``priority`` (small is urgent) a region keeps the most urgent code of a process.
    """
    near, names = _small(rules)
    held = long_form(features, names).join(near, "feature").where(F.col("value").between(F.col("lo"), F.col("hi")))
    codes = held.groupBy(*KEY, "process", "code", "n_conditions").agg(F.count("*").alias("n")).where("n = n_conditions").select(*KEY, "process", "code")
    if priority is None:
        return codes
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in priority.items() for x in kv])[F.col("code")], F.lit(1 << 30)) if priority else F.lit(0)
    return codes.groupBy(*KEY, "process").agg(F.min_by("code", F.struct(rank.alias("rank"), "code")).alias("code"))


#: What each process looks for, as features and the side that marks the defect; thresholds come from site data.
PROCESS_FEATURES = {
    "coater": {"pinhole": {"circularity": "high", "area": "low"}, "uncoated": {"area": "high"}, "tear": {"convexity": "low"}, "bubbles": {"holes": "high", "euler": "low"}},
    "roll_press": {"wrinkle": {"anisometry": "high", "orientation": "any"}, "crack": {"anisometry": "high"}, "pressed_in": {"rectangularity": "high"}},
    "slitter": {"burr": {"roundness": "low", "sides": "any"}, "bad_cut": {"contlength_by_diameter": "high"}},
}


def process_rules(spark: SparkSession, process: str, thresholds: dict[str, dict[str, tuple[float, float]]]) -> DataFrame:
    """Rules of ``process`` with ``thresholds[code][feature] = (lo, hi)`` for every feature that the process names."""
    wanted = PROCESS_FEATURES[process]
    if missing := [f"{code}.{f}" for code, fs in wanted.items() for f in fs if f not in thresholds.get(code, {})]:
        raise ValueError(f"{process}: no threshold for {', '.join(missing)}")
    return rule_rows(spark, [(process, code, [(f, *thresholds[code][f]) for f in fs]) for code, fs in wanted.items()])
