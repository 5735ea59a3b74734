"""Consumption marts over facts and dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medlar.functions import periods as P
from medlar.operators import checks


def labelled_kpi(kpi: DataFrame, college: DataFrame, period: DataFrame) -> DataFrame:
    """The indicator and its parts with readable labels."""
    return kpi.join(college, "college_id").join(period.select("period_ordinal", "period_label", "academic_year", "semester_number"), "period_ordinal")


def against_average(kpi: DataFrame, measure: str, period: str) -> DataFrame:
    """Adds the plain average of all groups of the period and the difference to it; a window, no join back."""
    average = F.avg(measure).over(Window.partitionBy(period))
    return kpi.withColumn("campus_avg", average).withColumn("vs_campus_avg", F.col(measure) - F.col("campus_avg"))


def weighted_average(value: str, weight: str) -> Column:
    return F.try_divide(F.sum(F.col(weight) * F.col(value)), F.nullif(F.sum(weight), F.lit(0)))


def executive_summary(kpi: DataFrame, period: Sequence[str]) -> DataFrame:
    """One row per period: sums, and rates weighted by enrollment."""
    return kpi.groupBy(*period).agg(
        F.sum("enrollment_count").alias("total_enrollment"), F.sum("graduation_count").alias("total_graduates"), F.sum("dropout_count").alias("total_dropouts"),
        F.try_divide(F.sum("dropout_count").cast("double"), F.sum("enrollment_count")).alias("overall_dropout_rate"),
        weighted_average("retention_rate", "enrollment_count").alias("overall_retention_rate"), weighted_average("success_rate", "enrollment_count").alias("overall_success_rate"),
    )


def program_performance(measures: DataFrame, program: DataFrame, period: DataFrame) -> DataFrame:
    """Counts and dropout rate of each program and period, for those with enrollment."""
    counted = measures.groupBy("program_id", "period_ordinal").agg(F.sum("enrolled").alias("enrollment_count"), F.sum("graduated").alias("graduation_count"), F.sum("dropped").alias("dropout_count"))
    rated = counted.withColumn("dropout_rate", F.try_divide(F.col("dropout_count").cast("double"), F.col("enrollment_count")))
    return rated.join(program, "program_id").join(period.select("period_ordinal", "period_label", "academic_year"), "period_ordinal")


def retention_risk(measures: DataFrame, program: DataFrame, period: DataFrame) -> DataFrame:
    """Retention of each program and period beside the two before it, and whether it fell twice; from the third row on."""
    rate = measures.where("retained IS NOT NULL").groupBy("program_id", "period_ordinal").agg(F.avg(F.col("retained").cast("double")).alias("retention_rate"))
    order = Window.partitionBy("program_id").orderBy("period_ordinal")
    seen = rate.withColumn("retention_rate_prev1", F.lag("retention_rate", 1).over(order)).withColumn("retention_rate_prev2", F.lag("retention_rate", 2).over(order))
    seen = seen.where("retention_rate_prev2 IS NOT NULL")
    fell = (F.col("retention_rate") < F.col("retention_rate_prev1")) & (F.col("retention_rate_prev1") < F.col("retention_rate_prev2"))
    return seen.withColumn("is_declining_twice", fell).join(program, "program_id").join(period.select("period_ordinal", "period_label"), "period_ordinal")


def canonical(enrolled: DataFrame, shifted: DataFrame, college: DataFrame, program: DataFrame, period: DataFrame) -> DataFrame:
    """One row per year, semester, college, program, gender and year level. Graduates, dropouts and shifters are counted
    without the year level, so they repeat on each of its rows and are not to be summed over it."""
    named = enrolled.join(college, "college_id").join(program.drop("college_id"), "program_id").join(period.select("period_ordinal", "year_label", "semester_label"), "period_ordinal")
    named = named.select(
        F.col("year_label").alias("academic_year"), F.col("semester_label").alias("semester"), F.col("college_name").alias("college"), F.col("program_name").alias("program"), "gender",
        P.year_level_label(F.col("year_level"), F.col("nominal_duration_years")).alias("year_level"), "enrollment_status", "is_new_enrollee", "admission_type",
    )
    key = ["academic_year", "semester", "college", "program", "gender"]
    freshman = F.col("is_new_enrollee") & (F.col("admission_type") == "Freshman")
    base = named.groupBy(*key, "year_level").agg(F.sum(F.when(freshman, 1).otherwise(0)).alias("freshmen_count"), F.count("*").alias("enrolled"))
    ended = named.groupBy(*key).agg(F.count(F.when(F.col("enrollment_status") == "GRADUATED", 1)).alias("graduates"), F.count(F.when(F.col("enrollment_status") == "DROPPED", 1)).alias("dropouts"))
    origin = program.select(F.col("program_id").alias("from_program_id"), F.col("program_name").alias("program"), F.col("college_id").alias("from_college"))
    left = shifted.join(origin, "from_program_id").join(college.select(F.col("college_id").alias("from_college"), F.col("college_name").alias("college")), "from_college")
    left = left.join(enrolled.select("student_id", "gender").distinct(), "student_id").join(period.select("period_ordinal", F.col("year_label").alias("academic_year"), F.col("semester_label").alias("semester")), "period_ordinal")
    left = left.groupBy(*key).agg(F.count("*").alias("shifters"))
    whole = base.join(ended, key, "left").join(left, key, "left")
    nothing = F.lit(None).cast("int")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("graduates", "dropouts", "shifters")]
    return whole.select(*key, "year_level", "freshmen_count", nothing.alias("applicants"), nothing.alias("accepted"), "enrolled", *counts)


# Columns of the canonical mart.
CANONICAL = (
    "academic_year", "semester", "college", "program", "gender", "year_level", "freshmen_count", "applicants", "accepted", "enrolled", "graduates", "dropouts", "shifters"
)


def canonical_violations(df: DataFrame) -> DataFrame:
    """(check, violations) of the canonical mart's contract; raises if its columns are not exactly those."""
    differences = checks.schema_differences(df, CANONICAL)
    if differences["missing"] or differences["extra"]:
        raise ValueError(f"columns: {differences}")
    wanted = [
        checks.matches("academic_year", r"^\d{4}-\d{4}$"), checks.accepted_values("semester", list(P.SEMESTER_LABELS.values())),
        checks.accepted_values("year_level", [*P.LEVEL_LABELS.values(), P.LAST_LEVEL_LABEL]), *[checks.not_null(c) for c in CANONICAL[:6]], *[checks.in_range(c, 0) for c in CANONICAL[6:]],
    ]
    return checks.violations(df, wanted)


def chronological(df: DataFrame, year: str, semester: str) -> DataFrame:
    """Sorted by label columns in order of time."""
    return df.orderBy(P.start_year(F.col(year)), P.semester_rank(F.col(semester)))
