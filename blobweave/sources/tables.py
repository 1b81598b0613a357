"""Process profiles from INI text, and feature vectors as CSV.

A profile file has a section per process; the keys of a feature are ``name.vMin``,
``name.vMax`` and ``name.dir`` (increasing or decreasing).
"""

from __future__ import annotations

import configparser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROFILE = "process string, feature string, v_min double, v_max double, direction string"
DIRECTIONS = ("increasing", "decreasing")


def parse_profile(text: str, known: set[str] | None = None) -> list[tuple[str, str, float, float, str]]:
    """Profile rows; raises ValueError for a feature that is not ``known`` or lacks a bound."""
    ini = configparser.ConfigParser(interpolation=None)
    ini.optionxform = str  # names are case-sensitive
    ini.read_string(text)
    rows = []
    for process in ini.sections():
        keys = ini[process]
        for feature in sorted({k.rpartition(".")[0] for k in keys}):
            if known is not None and feature not in known:
                raise ValueError(f"[{process}] {feature}: no such feature")
            missing = [k for k in ("vMin", "vMax") if f"{feature}.{k}" not in keys]
            direction = keys.get(f"{feature}.dir", "increasing")
            if missing or direction not in DIRECTIONS:
                raise ValueError(f"[{process}] {feature}: {', '.join(missing) or direction}")
            rows.append((process, feature, float(keys[f"{feature}.vMin"]), float(keys[f"{feature}.vMax"]), direction))
    return rows


def read_profile(spark: SparkSession, path: str, known: set[str] | None = None) -> DataFrame:
    """The profile table of an INI file in any store that Spark reads."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    return spark.createDataFrame(parse_profile(text, known), PROFILE)


def flat(features: DataFrame) -> DataFrame:
    """Structs as columns ``struct_field``; arrays as their elements joined by spaces."""
    columns = []
    for f in features.schema:
        if isinstance(f.dataType, T.StructType):
            columns += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}_{g.name}") for g in f.dataType]
        elif isinstance(f.dataType, T.ArrayType):
            columns.append(F.array_join(F.transform(f.name, lambda x: x.cast("string")), " ").alias(f.name))
        else:
            columns.append(F.col(f"`{f.name}`"))
    return features.select(*columns)


def write_csv(features: DataFrame, path: str) -> None:
    flat(features).write.option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, like: T.StructType) -> DataFrame:
    """What ``write_csv`` wrote of features of schema ``like``, structs and arrays put together again; nulls and infinite numbers are kept."""

    def leaf(c: Column, kind: T.DataType) -> Column:
        return F.transform(F.split(c, " "), lambda x: x.cast(kind.elementType)) if isinstance(kind, T.ArrayType) else c

    fields, columns = [], []
    for f in like:
        if isinstance(f.dataType, T.StructType):
            fields += [T.StructField(f"{f.name}_{g.name}", g.dataType) for g in f.dataType]
            columns.append(F.struct(*[leaf(F.col(f"`{f.name}_{g.name}`"), g.dataType).alias(g.name) for g in f.dataType]).alias(f.name))
        else:
            fields.append(T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.ArrayType) else f.dataType))
            columns.append(leaf(F.col(f"`{f.name}`"), f.dataType).alias(f.name))
    rows = spark.read.options(header=True, positiveInf="Infinity", negativeInf="-Infinity", nanValue="NaN", enforceSchema=False).schema(T.StructType(fields)).csv(path)
    return rows.select(*columns)
