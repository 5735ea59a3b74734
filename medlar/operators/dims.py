"""Dimensions: periods, days, vocabularies, surrogate keys and histories of change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medlar.functions import periods as P
from medlar.sources import files


def academic_periods(spark: SparkSession, calendar: P.Calendar) -> DataFrame:
    """(academic_period_key, academic_year, semester_number, period_ordinal, labels); the key is the ordinal plus 1."""
    ordinal = F.col("id").cast("int")
    known = spark.range(calendar.periods).select(ordinal.alias("period_ordinal"))
    known = known.withColumn("academic_year", calendar.year_of(F.col("period_ordinal"))).withColumn("semester_number", calendar.semester_of(F.col("period_ordinal")))
    year, semester = F.col("academic_year"), F.col("semester_number")
    return known.select(
        (F.col("period_ordinal") + 1).alias("academic_period_key"), "academic_year", "semester_number", "period_ordinal",
        P.year_label(year).alias("year_label"), P.semester_label(semester).alias("semester_label"), P.period_label(year, semester).alias("period_label"),
    )


def calendar_days(spark: SparkSession, calendar: P.Calendar) -> DataFrame:
    """A row for each day, with its parts, its semester and whether it is the first or last day of one."""
    first, last = F.make_date(F.lit(calendar.first_year), F.lit(1), F.lit(1)), F.make_date(F.lit(calendar.last_year), F.lit(12), F.lit(31))
    days = spark.range(1).select(F.explode(F.sequence(first, last)).alias("full_date"))
    day = F.col("full_date")
    year, semester = F.year(day), P.semester_of_date(day)
    month_day = F.date_format(day, "MM-dd")
    return days.select(
        F.date_format(day, "yyyyMMdd").cast("int").alias("date_key"), day, year.alias("year"), F.quarter(day).alias("quarter"), F.month(day).alias("month"), F.dayofmonth(day).alias("day"),
        calendar.ordinal(year, semester).alias("period_ordinal"), month_day.isin("01-01", "07-01").alias("is_semester_start"), month_day.isin("06-30", "12-31").alias("is_semester_end"),
    )


def vocabulary(spark: SparkSession, key: str, label: str, values: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(values, 1)), f"{key} int, {label} string")


def with_surrogate_key(df: DataFrame, key: str, natural: Sequence[str]) -> DataFrame:
    """Numbers from 1 in order of the natural key. One task numbers all rows: for small dimensions."""
    return df.withColumn(key, F.row_number().over(Window.orderBy(*natural)))


def with_large_surrogate_key(df: DataFrame, key: str, natural: Sequence[str]) -> DataFrame:
    """The same for tables that grow: rows are dealt by ranges of the natural key and written once, each range is numbered
    by itself and moved by the rows of the ranges before it."""
    spark = df.sparkSession
    folder = files.scratch(spark)
    df.repartitionByRange(*natural).withColumn("__range", F.spark_partition_id()).write.parquet(folder)
    dealt = spark.read.parquet(folder)
    before = F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = dealt.groupBy("__range").agg(F.count("*").alias("n")).select("__range", before.alias("__before"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*natural))
    numbered = dealt.withColumn("__place", place).join(F.broadcast(ranges), "__range")
    return numbered.select(*df.columns, (F.col("__before") + F.col("__place")).cast("int").alias(key))


def spells(entries: DataFrame, changes: DataFrame, entity: str, ordinal: str, value: str, new_value: str) -> DataFrame:
    """Type-2 history: (entity, value, valid_from, valid_to, is_current), in ordinals, valid_to null while open.

    ``entries`` has each entity's first ordinal and value, ``changes`` later values by ordinal. A change at the entry's
    ordinal replaces the entry's value, any other closes the spell before it. One shuffle by entity.
    """
    key = [entity, ordinal]
    started = entries.select(entity, ordinal, F.col(value).alias("__value"), F.lit(1).alias("__entry"))
    changed = changes.select(entity, ordinal, F.col(new_value).alias("__value"), F.lit(0).alias("__entry"))
    at = started.unionByName(changed).groupBy(*key).agg(F.max_by("__value", -F.col("__entry")).alias(value))
    history = Window.partitionBy(entity).orderBy(ordinal)
    end = F.lead(ordinal).over(history) - 1
    return at.select(entity, value, F.col(ordinal).alias("valid_from"), end.alias("valid_to")).withColumn("is_current", F.col("valid_to").isNull())


def covers(ordinal: Column, valid_from: Column, valid_to: Column) -> Column:
    return (ordinal >= valid_from) & (valid_to.isNull() | (ordinal <= valid_to))
