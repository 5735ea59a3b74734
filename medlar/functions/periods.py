"""Academic periods as column expressions: ordinals, labels and dates. Semesters are 1 and 2; a period's ordinal counts
from the first semester of a base year."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of semesters and year levels.
SEMESTER_LABELS = {1: "1st Semester", 2: "2nd Semester"}
LEVEL_LABELS = {1: "Freshman", 2: "Sophomore", 3: "Junior", 4: "Senior"}
LAST_LEVEL_LABEL = "Super Senior"
DOT = "·"


@dataclass(frozen=True)
class Calendar:
    """The years that periods come from."""

    first_year: int
    last_year: int

    @property
    def periods(self) -> int:
        return 2 * (self.last_year - self.first_year + 1)

    def ordinal(self, year: Column, semester: Column) -> Column:
        return ((year - self.first_year) * 2 + semester - 1).cast("int")

    def year_of(self, ordinal: Column) -> Column:
        return (F.floor(ordinal / 2) + self.first_year).cast("int")

    def semester_of(self, ordinal: Column) -> Column:
        return (F.pmod(ordinal, F.lit(2)) + 1).cast("int")


def semester_of_date(date: Column) -> Column:
    return F.when(F.month(date) <= 6, 1).otherwise(2).cast("int")


def year_label(year: Column) -> Column:
    """2021 as 2021-2022."""
    return F.concat_ws("-", year.cast("string"), (year + 1).cast("string"))


def semester_label(semester: Column) -> Column:
    return F.when(semester == 1, SEMESTER_LABELS[1]).when(semester == 2, SEMESTER_LABELS[2])


def period_label(year: Column, semester: Column) -> Column:
    return F.concat(year_label(year), F.lit(f" {DOT} "), semester_label(semester))


def start_year(label: Column) -> Column:
    """The year from a label such as 2021-2022, a number as text or a number; null if there is none."""
    return F.split_part(F.trim(label.cast("string")), F.lit("-"), F.lit(1)).try_cast("int")


def semester_rank(label: Column) -> Column:
    """Sorts semester labels; null for unknown ones."""
    return F.when(label == SEMESTER_LABELS[1], 1).when(label == SEMESTER_LABELS[2], 2)


def period_start(year: Column, semester: Column) -> Column:
    """January 1st of a first semester, July 1st of a second."""
    return F.make_date(year, F.when(semester == 1, 1).otherwise(7), F.lit(1))


def is_beyond_duration(level: Column, duration: Column) -> Column:
    return level > F.ceil(duration)


def year_level_label(level: Column, duration: Column) -> Column:
    """Names of the first four levels; a later one is beyond the program's duration or, in a longer program, on time."""
    named = F.when(level <= 1, LEVEL_LABELS[1])
    for n in (2, 3, 4):
        named = named.when(level == n, LEVEL_LABELS[n])
    return named.when(is_beyond_duration(level, duration), LAST_LEVEL_LABEL).otherwise(LEVEL_LABELS[4])


def level_of_cohort(year: Column, cohort_year: Column, most: int = 6) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(1), year - cohort_year + 1)).cast("int")


def model_version(series: Column, metric: Column, trained_at: Column) -> Column:
    return F.concat_ws("_", series, metric, F.date_format(trained_at, "yyyyMMdd'T'HHmmss'Z'"))


def partition_part(key: Column, name: str) -> Column:
    """A part of a partition key such as academic_year=2021/semester=1."""
    return F.nullif(F.regexp_extract(key, rf"(?:^|/){name}=([^/]+)", 1), F.lit(""))


def interpolate(x: Column, points: list[tuple[float, float]]) -> Column:
    """The broken line through the points, flat outside them."""
    line = F.when(x <= points[0][0], points[0][1])
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        line = line.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return line.otherwise(points[-1][1])
