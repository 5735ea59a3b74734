"""Removal of duplicates by one window each; ties are broken so that results don't depend on the order of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, key: Sequence[str], newest_first: Sequence[Column]) -> DataFrame:
    """One row per key: the first in the given order. Nulls in a key count as equal."""
    order = Window.partitionBy(*key).orderBy(*newest_first)
    return df.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")


def last_write_wins(df: DataFrame, key: Sequence[str], written: str) -> DataFrame:
    """The row of each key that was written last; among equal times the greatest in the other columns."""
    rest = [c for c in df.columns if c not in {*key, written}]
    return latest_per_key(df, key, [F.col(written).desc_nulls_last(), *(F.col(c).desc_nulls_last() for c in rest)])


def collapse_copies(df: DataFrame, audit: Sequence[str], written: str) -> DataFrame:
    """One row for all that are equal but for audit columns, the one written last."""
    business = [c for c in df.columns if c not in audit]
    rest = [c for c in audit if c != written]
    return latest_per_key(df, business, [F.col(written).desc_nulls_last(), *(F.col(c).desc_nulls_last() for c in rest)])


def copies(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys with more than one row: (key, n)."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
