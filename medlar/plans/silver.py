"""From landed extracts to clean entities: cleaning, validation and business rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medlar.functions import normalize as N
from medlar.functions import periods as P
from medlar.operators import checks, dedupe, facts, rules
from medlar.sources.bronze import AUDIT_COLUMNS

# Columns of the entities with their types, and vocabularies of columns.
ENTITIES = {
    "college": {"college_id": "string", "college_name": "string"},
    "program": {"program_id": "string", "program_name": "string", "college_id": "string", "program_level": "string", "nominal_duration_years": "double"},
    "student": {
        "student_id": "string", "cohort_academic_year": "int", "gender": "string", "birth_year": "int", "home_province": "string", "admission_type": "string",
        "entry_year_level": "int", "entry_college_id": "string", "entry_program_id": "string",
    },
    "enrollment": {
        "student_id": "string", "academic_year": "int", "semester_number": "int", "college_id": "string", "program_id": "string", "enrollment_status": "string",
        "year_level": "int", "units_enrolled": "int", "is_new_enrollee": "boolean",
    },
    "graduation": {"student_id": "string", "academic_year": "int", "semester_number": "int", "program_id": "string", "college_id": "string", "years_to_complete": "double"},
    "dropout": {
        "student_id": "string", "academic_year": "int", "semester_number": "int", "program_id": "string", "college_id": "string", "dropout_reason": "string",
        "semesters_completed_before_dropout": "int",
    },
    "shifter": {"student_id": "string", "academic_year": "int", "semester_number": "int", "from_program_id": "string", "to_program_id": "string"},
    "admissions": {"college_id": "string", "program_id": "string", "academic_year": "int", "applicants": "int", "accepted": "int", "enrolled_freshmen": "int"},
}
VOCABULARIES = {"gender": ("Female", "Male"), "admission_type": ("Freshman", "Transferee"), "program_level": ("Bachelor", "Certificate", "Diploma")}
# Natural keys, columns of years, and levels beyond a program's duration that are allowed.
NATURAL_KEYS = {"enrollment": ["student_id", "academic_year", "semester_number"], "shifter": ["student_id", "academic_year", "semester_number"]}
YEARS = ("academic_year", "cohort_academic_year")
PERIOD = ["student_id", "academic_year", "semester_number"]
LEVEL_BUFFER = 2
# Unique columns, columns that may be null, and ranges of numbers.
UNIQUE = {"college": "college_id", "program": "program_id", "student": "student_id"}
OPTIONAL = ("home_province",)
RANGES = {
    "birth_year": (1980, 2010), "nominal_duration_years": (0.5, 10), "entry_year_level": (1, None), "year_level": (1, None), "units_enrolled": (0, None), "semester_number": (1, 2),
    "semesters_completed_before_dropout": (0, None), "applicants": (0, None), "accepted": (0, None), "enrolled_freshmen": (0, None),
}


@dataclass(frozen=True)
class Cleaned:
    """An entity and one row of counts of what cleaning met."""

    rows: DataFrame
    stats: DataFrame


def clean(landed: DataFrame, entity: str) -> Cleaned:
    """Trims text, makes blanks null, maps vocabularies, reads years and semesters, casts and collapses exact copies.

    Columns that the entity doesn't have go, audit columns stay. A value that can't be cast becomes null and is counted.
    Cleaning is one projection and one window; the counts are one aggregation.
    """
    columns = ENTITIES[entity]
    text = {c: N.nullify(F.col(c).cast("string")) for c in columns}
    made = {}
    for c, kind in columns.items():
        if c == "enrollment_status":
            made[c] = N.status(text[c])
        elif c in VOCABULARIES:
            made[c] = N.category(text[c], VOCABULARIES[c])
        elif c in YEARS:
            made[c] = P.start_year(text[c])
        elif c == "semester_number":
            made[c] = N.whole_number(N.semester(text[c])).cast("int")
        elif kind == "int":
            made[c] = N.whole_number(text[c]).cast("int")
        else:
            made[c] = text[c] if kind == "string" else text[c].try_cast(kind)
    audit = [c for c in AUDIT_COLUMNS if c in landed.columns]
    read = landed.select(*[v.alias(c) for c, v in made.items()], *audit, *[N.lost(text[c], v).alias(f"__lost_{c}") for c, v in made.items() if columns[c] != "string"])
    whole = read.select(*columns, *audit)
    rows = dedupe.collapse_copies(whole, audit, "_ingested_at") if "_ingested_at" in audit else whole.distinct()
    words = [c for c in columns if c in VOCABULARIES]
    count = lambda condition: F.count(F.when(condition, 1))
    none = F.lit(0).cast("long")
    lost = [count(F.col(c)) for c in read.columns if c.startswith("__lost_")]
    stats = read.agg(
        F.count("*").alias("rows"), count(N.is_unknown(F.col("enrollment_status"))).alias("unknown_status") if "enrollment_status" in columns else none.alias("unknown_status"),
        sum((count(N.is_unknown(F.col(c))) for c in words), none).alias("unknown_category"), sum(lost, none).alias("coercion_failures"),
        (F.count("*") - F.count_distinct(F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns]))).alias("duplicates_dropped"),
    )
    return Cleaned(rows, stats)


def validate_enrollment(enrollment: DataFrame, students: DataFrame, dropouts: DataFrame, calendar: P.Calendar) -> DataFrame:
    """The last-written row of each student and semester with the first rule that it fails: known_status, cohort_range,
    dropout_event, and then, judged on what passed those, progression."""
    ordinal = calendar.ordinal(F.col("academic_year"), F.col("semester_number"))
    written = "_ingested_at" if "_ingested_at" in enrollment.columns else "units_enrolled"
    last = dedupe.last_write_wins(enrollment, NATURAL_KEYS["enrollment"], written).withColumn("period_ordinal", ordinal)
    entry = students.select("student_id", calendar.ordinal(F.col("cohort_academic_year"), F.lit(1)).alias("__entry"))
    met = rules.with_flag(last.join(entry, "student_id", "left"), dropouts, PERIOD, "__event")
    tagged = rules.tag(
        met,
        [
            rules.Rule("known_status", ~N.is_unknown(F.col("enrollment_status"))),
            rules.Rule("cohort_range", F.col("period_ordinal").between(F.col("__entry"), F.lit(calendar.periods - 1))),
            rules.Rule("dropout_event", F.col("__event") == (F.col("enrollment_status") == "DROPPED")),
        ],
    ).drop("__entry", "__event")
    passed = F.col(rules.FAILED).isNull()
    judged = facts.illegal_transitions(tagged.withColumn("__passed", passed), ["student_id", "__passed"], "period_ordinal", "year_level")
    return judged.withColumn(rules.FAILED, F.when(passed & F.col("is_illegal"), "progression").otherwise(F.col(rules.FAILED))).drop("__passed", "is_illegal")


def contract(entity: str, calendar: P.Calendar, landed: bool = False) -> list[checks.Check]:
    """What a row of an entity promises: no nulls, no empty text, vocabularies and ranges. ``landed`` is for rows as they
    arrive, all text: vocabularies of columns that cleaning maps, and years, aren't judged there."""
    wanted: list[checks.Check] = []
    for column, kind in ENTITIES[entity].items():
        if column not in OPTIONAL:
            wanted.append(checks.not_null(column))
        if kind == "string" or landed:
            wanted.append(checks.Check(f"not_empty:{column}", F.coalesce(F.length(F.trim(F.col(column).cast("string"))) == 0, F.lit(False))))
        if column in VOCABULARIES and not (landed and column == "gender"):
            wanted.append(checks.accepted_values(column, VOCABULARIES[column]))
        if column in YEARS and not landed:
            wanted.append(checks.in_range(column, calendar.first_year, calendar.last_year))
        if column == "years_to_complete":
            number = F.col(column).try_cast("double") if landed else F.col(column)
            wanted.append(checks.Check(f"in_range:{column}", F.coalesce(number <= 0, F.lit(False))))
        if column in RANGES:
            low, high = RANGES[column]
            number = F.col(column).cast("string").try_cast("double") if landed else F.col(column)
            wanted.append(checks.outside(column, number, low, high))
    return wanted


def contract_report(entity: str, rows: DataFrame, calendar: P.Calendar, landed: bool = False) -> DataFrame:
    """(check, violations) of an entity's contract, from one pass and, where a column is unique, one aggregation."""
    found = checks.violations(rows, contract(entity, calendar, landed))
    if entity not in UNIQUE:
        return found
    key = UNIQUE[entity]
    twice = checks.not_unique(rows, [key]).agg(F.lit(f"unique:{key}").alias("check"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("violations"))
    return found.unionByName(twice)


def first_failures(entity: str, rows: DataFrame, calendar: P.Calendar, key: Sequence[str], n: int = 5, landed: bool = False) -> DataFrame:
    """(check, key) of the first rows, in order of the key, that break each check of the contract: ``n`` of each at most."""
    broken = F.array_compact(F.array(*[F.when(c.broken, F.lit(c.name)) for c in contract(entity, calendar, landed)]))
    each = rows.select(F.explode(broken).alias("check"), *key)
    order = Window.partitionBy("check").orderBy(*key)
    return each.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= n).drop("__place")


def duplicate_share(before: DataFrame, after: DataFrame) -> float:
    n = before.count()
    return 0.0 if not n else 1 - after.count() / n


def business_rules(entity: str, rows: DataFrame, programs: DataFrame, colleges: DataFrame, calendar: P.Calendar) -> tuple[DataFrame, list[rules.Rule]]:
    """An entity's rows tagged by its business rules, and the rules; gate each with ``rules.enforce`` before publishing."""
    chain: list[rules.Rule] = []
    if entity == "program":
        rows = rules.with_flag(rows, colleges, ["college_id"], "__college")
        chain.append(rules.Rule("college_known", F.col("__college")))
    if "semester_number" in rows.columns:
        chain.append(rules.Rule("semester_number", F.col("semester_number").isin(1, 2)))
        chain.append(rules.Rule("academic_year", F.col("academic_year").between(calendar.first_year, calendar.last_year)))
    if {"program_id", "college_id"} <= set(rows.columns) and entity != "program":
        known = programs.select("program_id", F.col("college_id").alias("__owner"), F.col("nominal_duration_years").alias("__duration"))
        rows = rows.join(known, "program_id", "left")
        chain.append(rules.Rule("program_college", F.col("__owner") == F.col("college_id")))
        if "year_level" in rows.columns:
            chain.append(rules.Rule("year_level", F.col("year_level").between(F.lit(1), F.ceil("__duration") + LEVEL_BUFFER)))
    if entity == "shifter":
        for side in ("from_program_id", "to_program_id"):
            known = programs.select(F.col("program_id").alias(side))
            rows = rules.with_flag(rows, known, [side], f"__{side}")
            chain.append(rules.Rule(side, F.col(f"__{side}")))
    if entity == "admissions":
        chain.append(rules.Rule("funnel", rules.funnel("applicants", "accepted", "enrolled_freshmen")))
    chain.append(rules.Rule("non_negative", rules.non_negative(rows, ["units_enrolled", "semesters_completed_before_dropout", "years_to_complete", "applicants", "accepted"])))
    return rules.tag(rows, chain).drop(*[c for c in rows.columns if c.startswith("__")]), chain
