"""The weighted composite indicator of a group and period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of the composite's parts; the dropout rate counts by what it leaves of 1.
WEIGHTS = {
    "graduation_rate": 0.30,
    "retention_rate": 0.25,
    "dropout_rate": 0.20,
    "program_completion_momentum": 0.15,
    "shifter_stability": 0.05,
    "enrollment_stability": 0.05,
}


def success_rate() -> Column:
    if abs(sum(WEIGHTS.values()) - 1) > 1e-4:
        raise ValueError("weights must sum to 1")
    parts = [w * ((1 - F.col(c)) if c == "dropout_rate" else F.col(c)) for c, w in WEIGHTS.items()]
    total = parts[0]
    for p in parts[1:]:
        total += p
    return F.round(total * 100, 1)


def stability(value: str, group: Sequence[str], ordinal: str) -> Column:
    """1 less the relative change since the group's previous row, from 0 to 1; 1 where there is none to compare."""
    before = F.lag(value).over(Window.partitionBy(*group).orderBy(ordinal))
    change = F.try_divide(F.abs(F.col(value) - before).cast("double"), before)
    return F.when(change.isNull(), 1.0).otherwise(F.least(F.greatest(1 - change, F.lit(0.0)), F.lit(1.0)))


def institution_kpi(measures: DataFrame, group: Sequence[str], ordinal: str) -> DataFrame:
    """Counts, rates and the composite of each group and ordinal.

    ``measures`` has a row per event: enrolled, eligible, graduated, dropped, shifted (0 or 1), retained and moved_up (0, 1
    or null where the event says nothing of it). One aggregation and one window, both by the group.
    """
    counted = measures.groupBy(*group, ordinal).agg(
        F.sum("enrolled").alias("enrollment_count"), F.sum("eligible").alias("eligible_count"), F.sum("graduated").alias("graduation_count"),
        F.sum("dropped").alias("dropout_count"), F.sum("shifted").alias("shifter_count"),
        F.avg(F.col("retained").cast("double")).alias("retention"), F.avg(F.col("moved_up").cast("double")).alias("momentum"),
    )
    enrolled = F.nullif(F.col("enrollment_count"), F.lit(0))
    rated = counted.select(
        *group, ordinal, "enrollment_count", "graduation_count", "dropout_count", "shifter_count",
        F.coalesce("retention", F.lit(0.0)).alias("retention_rate"),
        F.coalesce(F.try_divide(F.col("graduation_count").cast("double"), F.col("eligible_count")), F.lit(0.0)).alias("graduation_rate"),
        F.try_divide(F.col("dropout_count").cast("double"), enrolled).alias("dropout_rate"),
        (1 - F.try_divide(F.col("shifter_count").cast("double"), enrolled)).alias("shifter_stability"),
        stability("enrollment_count", group, ordinal).alias("enrollment_stability"),
        F.coalesce("momentum", F.lit(0.0)).alias("program_completion_momentum"),
    )
    return rated.withColumn("success_rate", success_rate())
