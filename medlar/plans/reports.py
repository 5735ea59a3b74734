"""Reports on extracts before they land and on reference data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medlar.functions.periods import Calendar
from medlar.operators import checks, facts
from medlar.plans import silver

STATUS = "check string, status string, found long"


def _line(name: str, found: DataFrame | int) -> DataFrame | tuple[str, int]:
    return name, found if isinstance(found, int) else found.count()


def reference_integrity(colleges: DataFrame, programs: DataFrame) -> DataFrame:
    """(check, status, found) for repeated ids and programs of unknown colleges."""
    lines = [
        _line("college_id_unique", checks.not_unique(colleges, ["college_id"])),
        _line("program_id_unique", checks.not_unique(programs, ["program_id"])),
        _line("program_college", checks.orphans(programs, colleges, "college_id", "college_id")),
    ]
    return _report(colleges, lines)


def weights_problem(weights: dict[str, float], names: set[str], tolerance: float = 1e-3) -> str | None:
    """Why weights by name can't be used, if so."""
    if set(weights) != names:
        return f"weights of {sorted(set(weights) ^ names)} don't match"
    return None if abs(sum(weights.values()) - 1) <= tolerance else f"weights sum to {sum(weights.values())}"


def pre_ingestion(extracts: dict[str, DataFrame], calendar: Calendar) -> DataFrame:
    """(check, status, found): columns, repeated rows, orphans, uncovered periods and illegal transitions of extracts."""
    lines = [_line(f"{n}_columns", len(checks.schema_differences(df, list(silver.ENTITIES[n]))["missing"])) for n, df in sorted(extracts.items())]
    for name, df in sorted(extracts.items()):
        columns = [c for c in silver.ENTITIES[name] if c in df.columns]
        repeated = df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        lines.append((f"{name}_repeated_rows", int(repeated)))
    enrolled = silver.clean(extracts["enrollment"], "enrollment").rows
    student = extracts["student"]
    lines.append(_line("enrollment_orphans", checks.orphans(enrolled, student, "student_id", "student_id")))
    at = enrolled.withColumn("period_ordinal", calendar.ordinal(F.col("academic_year"), F.col("semester_number")))
    wanted = enrolled.sparkSession.range(calendar.periods).select(F.col("id").cast("int").alias("period_ordinal"))
    lines.append(_line("uncovered_periods", wanted.join(at.select("period_ordinal").distinct(), "period_ordinal", "left_anti")))
    single = at.groupBy("student_id", "period_ordinal").agg(F.max("year_level").alias("year_level"))
    lines.append(_line("illegal_transitions", facts.illegal_transitions(single, "student_id", "period_ordinal", "year_level").where("is_illegal")))
    return _report(enrolled, lines)


def _report(any_of: DataFrame, lines: list) -> DataFrame:
    return any_of.sparkSession.createDataFrame([(n, "OK" if not found else "ATTENTION", found) for n, found in lines], STATUS)
