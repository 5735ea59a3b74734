"""The star schema from clean entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medlar.functions import periods as P
from medlar.operators import dims, facts, kpi

# Labels of year levels and genders.
LEVELS = ("Freshman", "Sophomore", "Junior", "Senior", "Fifth Year", "Sixth Year")
GENDERS = ("Female", "Male")


def dimensions(spark: SparkSession, silver: dict[str, DataFrame], calendar: P.Calendar) -> dict[str, DataFrame]:
    """Periods, days, levels, genders, colleges, programs and the students' history.

    A change before the student's entry or outside the calendar raises when the keys are resolved, it never vanishes.
    """
    college = dims.with_surrogate_key(silver["college"].select("college_id", "college_name").distinct(), "college_key", ["college_id"])
    program = dims.with_surrogate_key(silver["program"].select("program_id", "program_name", "college_id", "program_level", "nominal_duration_years").distinct(), "program_key", ["program_id"])
    student = silver["student"]
    entry = student.select("student_id", calendar.ordinal(F.col("cohort_academic_year"), F.lit(1)).alias("ordinal"), F.col("entry_program_id").alias("program_id"))
    changes = silver["shifter"].select("student_id", calendar.ordinal(F.col("academic_year"), F.col("semester_number")).alias("ordinal"), "to_program_id")
    history = dims.spells(entry, changes, "student_id", "ordinal", "program_id", "to_program_id")
    named = history.join(student.select("student_id", "gender", "admission_type", "home_province", "birth_year", F.col("entry_college_id").alias("college_id")), "student_id")
    return {
        "dim_academic_period": dims.academic_periods(spark, calendar),
        "dim_calendar": dims.calendar_days(spark, calendar),
        "dim_year_level": dims.vocabulary(spark, "year_level_key", "year_level_label", LEVELS).withColumn("year_level", F.col("year_level_key")),
        "dim_gender": dims.vocabulary(spark, "gender_key", "gender_label", GENDERS),
        "dim_college": college,
        "dim_program": program,
        "dim_student": dims.with_large_surrogate_key(named, "student_key", ["student_id", "valid_from"]),
    }


def fact_tables(silver: dict[str, DataFrame], dimension: dict[str, DataFrame], calendar: P.Calendar) -> dict[str, DataFrame]:
    """Enrollment, graduation, dropout, shift and retention facts with surrogate keys."""
    spells = dimension["dim_student"].select("student_id", "student_key", "valid_from", "valid_to", "is_current")
    ordinal = calendar.ordinal(F.col("academic_year"), F.col("semester_number"))

    def keyed(entity: str) -> DataFrame:
        rows = silver[entity].withColumn("period_ordinal", ordinal)
        rows = facts.as_of_join(rows, spells, "student_id", "period_ordinal")
        rows = facts.resolve(rows, dimension["dim_academic_period"], ["period_ordinal"], "academic_period_key")
        if "college_id" in rows.columns:
            rows = facts.resolve(rows, dimension["dim_college"], ["college_id"], "college_key")
        return facts.resolve(rows, dimension["dim_program"], ["program_id"], "program_key") if "program_id" in rows.columns else rows

    enrolled = facts.resolve(keyed("enrollment"), dimension["dim_year_level"], ["year_level"], "year_level_key")
    program = dimension["dim_program"].select("program_id", "program_key")
    moved = keyed("shifter")
    for side in ("from", "to"):
        moved = facts.resolve(moved, program.toDF(f"{side}_program_id", f"{side}_program_key"), [f"{side}_program_id"], f"{side}_program_key")
    where = ["student_key", "academic_period_key", "college_key", "program_key"]
    retained = facts.retention(enrolled, "student_key", "period_ordinal", "enrollment_status", enrolled.agg(F.max("period_ordinal")).first()[0] or 0)
    return {
        "fact_enrollment": enrolled.select(*where, "year_level_key", "enrollment_status", "units_enrolled", "is_new_enrollee", "period_ordinal"),
        "fact_graduation": keyed("graduation").select(*where, "years_to_complete", "period_ordinal"),
        "fact_dropout": keyed("dropout").select(*where, "dropout_reason", "semesters_completed_before_dropout", "period_ordinal"),
        "fact_shifter": moved.select("student_key", "academic_period_key", "from_program_key", "to_program_key", "period_ordinal"),
        "fact_retention": retained.select(*where, "is_retained", "period_ordinal"),
    }


KEYS = {
    "fact_enrollment": ["academic_period_key", "college_key", "program_key", "year_level_key"],
    "fact_graduation": ["academic_period_key", "college_key", "program_key"],
    "fact_dropout": ["academic_period_key", "college_key", "program_key"],
    "fact_shifter": ["academic_period_key", "from_program_key", "to_program_key"],
}


def institution_kpi(fact: dict[str, DataFrame], dimension: dict[str, DataFrame]) -> DataFrame:
    """The composite indicator of each college and period, from one union of all facts; shifts count for the college that
    the student left, progress and retention follow the student's spell."""
    program = dimension["dim_program"].join(dimension["dim_college"].select("college_id", "college_key"), "college_id")
    duration = program.select("program_key", F.ceil("nominal_duration_years").alias("__duration"))
    nothing, none = F.lit(0), F.lit(None).cast("int")
    base = {"enrolled": nothing, "eligible": nothing, "graduated": nothing, "dropped": nothing, "shifted": nothing, "retained": none, "moved_up": none}

    def rows(df: DataFrame, **of) -> DataFrame:
        return df.select("college_key", "period_ordinal", *[c.cast("int").alias(n) for n, c in (base | of).items()])

    before = facts.previous_in_sequence("student_key", "period_ordinal", F.col("year_level_key"))
    enrolled = fact["fact_enrollment"].join(duration, "program_key", "left").withColumn("__before", before)
    origin = program.select(F.col("program_key").alias("from_program_key"), "college_key")
    parts = [
        rows(enrolled, enrolled=F.lit(1), eligible=F.coalesce(F.col("year_level_key") >= F.col("__duration"), F.lit(False)), moved_up=F.when(F.col("__before").isNotNull(), F.col("year_level_key") > F.col("__before"))),
        rows(fact["fact_graduation"], graduated=F.lit(1)),
        rows(fact["fact_dropout"], dropped=F.lit(1)),
        rows(fact["fact_shifter"].join(origin, "from_program_key"), shifted=F.lit(1)),
        rows(fact["fact_retention"], retained=F.col("is_retained")),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return kpi.institution_kpi(whole, ["college_key"], "period_ordinal")


def build(spark: SparkSession, silver: dict[str, DataFrame], calendar: P.Calendar) -> dict[str, DataFrame]:
    """All tables of the star schema; raises if a fact has a key that no dimension knows."""
    dimension = dimensions(spark, silver, calendar)
    fact = fact_tables(silver, dimension, calendar)
    for name, keys in KEYS.items():
        facts.require_keys(fact[name], keys)
    return dimension | fact | {"fact_institution_kpi": institution_kpi(fact, dimension)}
