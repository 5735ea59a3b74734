"""Every query that has SQL gives the same rows, names and types in another engine."""

from __future__ import annotations

import duckdb
import pytest

import medlar.plans.jobs  # noqa: F401  (registers its queries)
from medlar.plans.queries import ORACLES, QUERIES, entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(value):
    return value.replace(tzinfo=None) if hasattr(value, "hour") and value is not None else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    other = duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(other.columns)
    types = dict(zip(other.columns, map(str, other.types), strict=True))
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    at = [other.columns.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in other.fetchall()), key=str)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry(spark, FOLDER).count() == 14


def test_whole_jobs(spark):
    """Every enrollment is labelled, every program is gated, and the newest test point is pivoted."""
    from medlar.plans import registrar as R

    assert QUERIES["year_level_labels"](spark, FOLDER).count() == R.enrollment(spark, FOLDER).count()
    assert QUERIES["retrain_gate"](spark, FOLDER).count() == R.programs(spark, FOLDER).count()
    assert QUERIES["pivot_actual_forecast"](spark, FOLDER).where("actual_13 IS NOT NULL").count() > 0
