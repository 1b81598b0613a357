"""Every registered region query against its SQL."""

from __future__ import annotations

import math

import duckdb
import pytest

from blobweave.plans.queries import QUERIES
from blobweave.plans.sql import SQL

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("embeddings", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(names: list[str], values: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(values_[i] for i in order) for values_ in values), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, DIR)
    found = db.sql(SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    got, want = rows(df.columns, [tuple(r) for r in df.collect()]), rows(found.columns, found.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, abs_tol=2e-6)) for x, y in zip(a, b, strict=True)), (a, b)


def test_control_totals(spark):
    got = QUERIES["q04_area_center"](spark, DIR)
    assert got.count() == 1279 and got.agg({"area": "sum"}).first()[0] == 10957
    assert QUERIES["q01_runs"](spark, DIR).count() == 7278 and QUERIES["q02_links"](spark, DIR).count() == 6375
