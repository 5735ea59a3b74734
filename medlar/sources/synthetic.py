"""A synthetic registrar: students, what becomes of them semester by semester, and noise as real extracts have it.

All chance comes from hashes of the seed, the student and the semester, so any partitioning gives the same rows. A student's
course is one pass of a state machine inside a row; no shuffle is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medlar.functions.periods import Calendar

# Yearly chances by year level, from the first to the last.
DROPOUT = (0.08, 0.05, 0.03, 0.02)
SHIFT = 0.06
STALL = 0.08
TYPOS, COPIES, LATE = 0.02, 0.01, 0.03


def chance(seed: int, *key: Column) -> Column:
    """A number from 0 to 1 that belongs to the key."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 40)).cast("double") / (1 << 40)


def students(spark: SparkSession, calendar: Calendar, per_year: int, programs: int, seed: int = 42) -> DataFrame:
    years = calendar.last_year - calendar.first_year + 1
    n = F.col("id")
    return spark.range(per_year * years).select(
        n.alias("student_id"), (F.pmod(n, F.lit(years)) + calendar.first_year).cast("int").alias("cohort_year"),
        F.floor(chance(seed, n, F.lit("program")) * programs).cast("int").alias("entry_program_id"),
        F.when(chance(seed, n, F.lit("gender")) < 0.5, "Female").otherwise("Male").alias("gender"),
        F.when(chance(seed, n, F.lit("admission")) < 0.1, "Transferee").otherwise("Freshman").alias("admission_type"),
    )


def progression(entered: DataFrame, calendar: Calendar, programs: int, duration: int = 4, seed: int = 43) -> DataFrame:
    """(student_id, period_ordinal, program_id, year_level, status) of each semester until the student leaves.

    In a semester a student first may drop out, then graduates if the time is served, then may change program once in the
    first two years; every second semester ends in the next level or the same again.
    """
    begin = ((F.col("cohort_year") - calendar.first_year) * 2).cast("int")
    empty = F.array().cast("array<struct<period_ordinal: int, program_id: int, year_level: int, status: string>>")
    state = F.struct(F.col("entry_program_id").alias("program"), F.lit(1).alias("level"), F.lit(False).alias("shifted"), F.lit(False).alias("gone"), empty.alias("rows"))

    def live(s: Column, at: Column) -> Column:
        u = lambda what: chance(seed, F.col("student_id"), at, F.lit(what))
        odds = F.element_at(F.array(*map(F.lit, DROPOUT)), F.least(s["level"], F.lit(len(DROPOUT)))) / 2
        served = at - begin
        drops = u("drop") < odds
        graduates = ~drops & (served >= 2 * duration - 1) & (s["level"] >= duration)
        shifts = ~drops & ~graduates & ~s["shifted"] & (served > 0) & (s["level"] <= 2) & (u("shift") < SHIFT / 2)
        program = F.when(shifts, F.pmod(s["program"] + 1 + F.floor(u("to") * (programs - 1)).cast("int"), F.lit(programs))).otherwise(s["program"])
        status = F.when(drops, "DROPPED").when(graduates, "GRADUATED").otherwise("ENROLLED")
        row = F.struct(at.alias("period_ordinal"), program.cast("int").alias("program_id"), s["level"].alias("year_level"), status.alias("status"))
        level = F.when((F.pmod(served, F.lit(2)) == 1) & (u("stall") >= STALL), F.least(s["level"] + 1, F.lit(6))).otherwise(s["level"])
        after = F.struct(program.cast("int").alias("program"), level.cast("int").alias("level"), (s["shifted"] | shifts).alias("shifted"), (drops | graduates).alias("gone"), F.concat(s["rows"], F.array(row)).alias("rows"))
        return F.when(s["gone"], s).otherwise(after)

    course = F.aggregate(F.sequence(begin, F.lit(calendar.periods - 1)), state, live, lambda s: s["rows"])
    return entered.select("student_id", F.explode(course).alias("r")).select("student_id", "r.*")


def swapped(text: Column, at: Column) -> Column:
    """With the characters at places ``at`` and after it, from 1, in each other's place; shorter text as it is."""
    pair = F.concat(F.substring(text, at + 1, F.lit(1)), F.substring(text, at, F.lit(1)))
    return F.when(F.length(text) > at, F.overlay(text, pair, at, F.lit(2))).otherwise(text)


def without_one(text: Column, at: Column) -> Column:
    """Without the character at place ``at``, from 1; of text under two characters nothing goes."""
    return F.when(F.length(text) > 1, F.overlay(text, F.lit(""), at, F.lit(1))).otherwise(text)


def with_noise(rows: DataFrame, key: tuple[str, ...], text: str, ordinal: str, calendar: Calendar, seed: int = 44) -> DataFrame:
    """Adds landed_ordinal, and noise: typos (two letters swapped or one dropped) and other case of ``text`` in some rows,
    exact copies of some, and some rows that arrive again in the next period under their own ordinal."""
    u = lambda what: chance(seed, *[F.col(k) for k in key], F.lit(what))
    value = F.col(text)
    at = (F.floor(u("at") * F.greatest(F.length(value) - 1, F.lit(1))) + 1).cast("int")
    mutated = F.when(u("kind") < 0.5, swapped(value, at)).otherwise(without_one(value, at))
    spelled = F.when(u("typo") < TYPOS, mutated).when(u("case") < TYPOS, F.concat(F.lit(" "), F.lower(value))).otherwise(value)
    noisy = rows.withColumn(text, spelled).withColumn("landed_ordinal", F.col(ordinal))
    again = noisy.where(u("copy") < COPIES)
    late = noisy.where((u("late") < LATE) & (F.col(ordinal) < calendar.periods - 1)).withColumn("landed_ordinal", F.col(ordinal) + 1)
    return noisy.unionByName(again).unionByName(late)


def admissions(enrolled: DataFrame, group: tuple[str, ...], seed: int = 45) -> DataFrame:
    """(group, enrolled_freshmen, accepted, applicants): the funnel that leads to the freshmen, built backwards."""
    counted = enrolled.groupBy(*group).agg(F.count("*").alias("enrolled_freshmen"))
    keys = [F.col(g) for g in group]
    return funnel_before(counted, "enrolled_freshmen", 0.5 + 0.4 * chance(seed, *keys, F.lit("yield")), 0.4 + 0.5 * chance(seed, *keys, F.lit("accept")))


def funnel_before(counted: DataFrame, enrolled: str, took_up: Column, accepted: Column) -> DataFrame:
    """Adds accepted and applicants: how many it took for ``enrolled`` at these shares, rounded up."""
    made = counted.withColumn("accepted", F.ceil(F.col(enrolled) / took_up).cast("long"))
    return made.withColumn("applicants", F.ceil(F.col("accepted") / accepted).cast("long"))


def outcomes(course: DataFrame, entered: DataFrame) -> DataFrame:
    """(cohort_year, active, graduated, dropped, students, balanced): every student is in exactly one of the three."""
    last = course.groupBy("student_id").agg(F.max_by("status", "period_ordinal").alias("status"))
    met = entered.select("student_id", "cohort_year").join(last, "student_id", "left")
    count = lambda s: F.count(F.when(F.col("status") == s, 1))
    sums = met.groupBy("cohort_year").agg(count("ENROLLED").alias("active"), count("GRADUATED").alias("graduated"), count("DROPPED").alias("dropped"), F.count("*").alias("students"))
    return sums.withColumn("balanced", F.col("active") + F.col("graduated") + F.col("dropped") == F.col("students"))
