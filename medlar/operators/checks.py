"""Constraints as queries: each gives the rows or keys that break it, or one line of counts for many at once."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """A condition on a row; ``broken`` is true where it doesn't hold."""

    name: str
    broken: Column


def not_null(column: str) -> Check:
    return Check(f"not_null:{column}", F.col(column).isNull())


def accepted_values(column: str, values: Sequence) -> Check:
    return Check(f"accepted_values:{column}", F.col(column).isNotNull() & ~F.col(column).isin(*values))


def in_range(column: str, low: float | None = None, high: float | None = None) -> Check:
    return outside(column, F.col(column), low, high)


def outside(column: str, number: Column, low: float | None = None, high: float | None = None) -> Check:
    """The same for a number that is read from a column."""
    broken = F.lit(False)
    if low is not None:
        broken |= number < low
    if high is not None:
        broken |= number > high
    return Check(f"in_range:{column}", F.coalesce(broken, F.lit(False)))


def matches(column: str, pattern: str) -> Check:
    return Check(f"matches:{column}", F.col(column).isNotNull() & ~F.col(column).rlike(pattern))


def violations(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """(check, violations) of every check, from one pass over the rows."""
    sums = [F.struct(F.lit(c.name).alias("check"), F.count(F.when(c.broken, 1)).alias("violations")) for c in checks]
    return df.agg(F.array(*sums).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def not_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, n) of keys with several rows; keys with nulls are left out."""
    whole = df.dropna(subset=list(key))
    return whole.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of the child whose key isn't null and isn't in the parent."""
    known = parent.select(F.col(parent_key).alias("__key"))
    return child.where(F.col(child_key).isNotNull()).join(known, F.col(child_key) == F.col("__key"), "left_anti")


def schema_differences(df: DataFrame, expected: Sequence[str]) -> dict[str, list[str]]:
    """Columns that are missing and that shouldn't be there."""
    return {"missing": sorted(set(expected) - set(df.columns)), "extra": sorted(set(df.columns) - set(expected))}


def fingerprint(df: DataFrame) -> DataFrame:
    """(rows, sum, mix): a fingerprint of a table that doesn't depend on the order of its rows."""
    own = F.xxhash64(*[F.col(c).cast("string") for c in sorted(df.columns)])
    return df.select(own.alias("h")).agg(F.count("*").alias("rows"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("sum"), F.bit_xor("h").alias("mix"))


def portable_fingerprint(df: DataFrame) -> DataFrame:
    """(rows, sum): a fingerprint that other engines can compute too: the sum, over rows, of the first eight hexadecimal
    digits of the MD5 of all columns, by name, as text with a stroke between them and nothing for null."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(df.columns)])
    return df.select(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long").alias("h")).agg(F.count("*").alias("rows"), F.coalesce(F.sum("h"), F.lit(0)).alias("sum"))


def content_digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
