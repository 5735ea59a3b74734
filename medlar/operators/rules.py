"""Declarative rules: every row gets the name of the first rule that it fails, in one pass; valid and quarantined rows are
two filters on that, so that together they are the input."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAILED = "failed_rule"
#: Share of rows that a batch may lose before it is held back.
MOST_QUARANTINED = 0.25


class GateError(ValueError):
    """A batch lost more rows than its gate allows."""


@dataclass(frozen=True)
class Rule:
    """``passes`` is true for valid rows; null counts as failed unless ``null_passes``."""

    name: str
    passes: Column
    null_passes: bool = False

    def holds(self) -> Column:
        return F.coalesce(self.passes, F.lit(self.null_passes))


def tag(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds the first failed rule's name, or null."""
    if not rules:
        return df.withColumn(FAILED, F.lit(None).cast("string"))
    return df.withColumn(FAILED, F.coalesce(*(F.when(~r.holds(), r.name) for r in rules)))


def split(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tagged.where(F.col(FAILED).isNull()).drop(FAILED), tagged.where(F.col(FAILED).isNotNull())


def tally(tagged: DataFrame) -> DataFrame:
    """(failed_rule, n), valid rows under null."""
    return tagged.groupBy(FAILED).agg(F.count("*").alias("n"))


def gate_report(tagged: DataFrame, rules: Sequence[Rule], most: float = MOST_QUARANTINED) -> DataFrame:
    """(rule, checked, failed, share, passed) of each rule; a rule is judged on the rows that came to it."""
    names = [r.name for r in rules]
    place = F.coalesce(*(F.when(F.col(FAILED) == n, F.lit(i)) for i, n in enumerate(names)), F.lit(len(names)))
    sums = [F.struct(F.lit(n).alias("rule"), F.sum(F.when(place >= i, 1).otherwise(0)).alias("checked"), F.sum(F.when(place == i, 1).otherwise(0)).alias("failed")) for i, n in enumerate(names)]
    report = tagged.agg(F.array(*sums).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    share = F.coalesce(F.try_divide(F.col("failed").cast("double"), F.col("checked")), F.lit(0.0))
    return report.withColumn("share", share).withColumn("passed", F.col("share") <= most)


def enforce(tagged: DataFrame, rules: Sequence[Rule], most: float = MOST_QUARANTINED) -> None:
    """Raises if a rule fails more than its share of rows."""
    broken = gate_report(tagged, rules, most).where("NOT passed").collect()
    if broken:
        raise GateError("; ".join(f"{r['rule']}: {r['failed']} of {r['checked']}" for r in broken))


def non_negative(df: DataFrame, columns: Sequence[str]) -> Column:
    """Null or at least 0 in all of the columns that there are."""
    there = [c for c in columns if c in df.columns]
    passes = F.lit(True)
    for c in there:
        passes &= F.col(c).isNull() | (F.col(c) >= 0)
    return passes


def funnel(*stages: str) -> Column:
    """No stage is larger than the one before it."""
    passes = F.lit(True)
    for before, after in zip(stages, stages[1:], strict=False):
        passes &= F.col(after) <= F.col(before)
    return passes


def with_flag(df: DataFrame, keys: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """Adds whether the row's key is among ``keys``; null keys aren't."""
    marked = keys.select(*on).distinct().withColumn(name, F.lit(True))
    return df.join(marked, list(on), "left").withColumn(name, F.coalesce(name, F.lit(False)))
