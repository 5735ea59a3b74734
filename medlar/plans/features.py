"""Features of a series that use only what lies before the row: lags, rolling and expanding means, trend, season, growth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lag_features(metric: str, series: Sequence[str], ordinal: str, season: str) -> list[Column]:
    """Both windows hash on the series or finer, so that one shuffle by the series serves them all."""
    order = Window.partitionBy(*series).orderBy(ordinal)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    seasonal = Window.partitionBy(*series, season).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    one, two = F.lag(metric, 1).over(order), F.lag(metric, 2).over(order)
    return [
        one.alias(f"{metric}_lag_1"), two.alias(f"{metric}_lag_2"), F.avg(metric).over(order.rowsBetween(-2, -1)).alias(f"{metric}_rolling_avg_2"),
        F.avg(metric).over(before).alias(f"{metric}_historical_avg"), F.regr_slope(F.col(metric), F.col(ordinal)).over(before).alias(f"{metric}_trend"),
        F.avg(metric).over(seasonal).alias(f"{metric}_seasonality"), F.try_divide((one - two).cast("double"), F.nullif(two, F.lit(0))).alias(f"{metric}_growth"),
    ]


def aligned_counts(left: DataFrame, right: DataFrame, key: Sequence[str], names: tuple[str, str]) -> DataFrame:
    """Rows of either table counted by key; a key that one of them lacks has 0 there. A full outer join of two counts."""
    one = left.groupBy(*key).agg(F.count("*").alias(names[0]))
    two = right.groupBy(*key).agg(F.count("*").alias(names[1]))
    return one.join(two, list(key), "full").select(*key, *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def features(counts: DataFrame, series: Sequence[str], ordinal: str, season: str, metrics: Sequence[str]) -> DataFrame:
    made = [c for m in metrics for c in [F.col(m), *lag_features(m, series, ordinal, season)]]
    return counts.select(*series, ordinal, season, *made)
