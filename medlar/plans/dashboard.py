"""What a dashboard reads: choices, histories, snapshots and where a forecast comes from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medlar.operators.dedupe import latest_per_key
from medlar.plans.forecasting import newest


def choices(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct().orderBy(*columns)


def history(df: DataFrame, ordinal: str, **of) -> DataFrame:
    """Rows whose columns have the given values, in order of time."""
    for column, value in of.items():
        df = df.where(F.col(column) == F.lit(value))
    return df.orderBy(ordinal)


def ranking(df: DataFrame, ordinal: str, measure: str, tie: str) -> DataFrame:
    """The rows of the last period, best first."""
    last = df.agg(F.max(ordinal).alias("__last"))
    return df.join(F.broadcast(last), F.col(ordinal) == F.col("__last"), "left_semi").orderBy(F.desc(measure), tie)


def snapshot(df: DataFrame, key: Sequence[str], ordinal: str) -> DataFrame:
    return latest_per_key(df, key, [F.desc(ordinal)])


def provenance(forecasts: DataFrame, registry: DataFrame, names: DataFrame, key: Sequence[str]) -> DataFrame:
    """Forecasts beside the entry of the registry that made them and the series' name."""
    key = list(key)
    made = newest(registry, [*key, "model_version"]).select(*key, "model_version", "trained_at", "mae", "is_champion")
    return forecasts.join(made, [*key, "model_version"], "left").join(names, key, "left")
