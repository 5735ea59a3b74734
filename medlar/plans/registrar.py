"""The registrar's entities from order tables: regions are colleges, customers students, and the last order of a customer in
a half-year is the enrollment of that semester."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medlar.functions import periods as P
from medlar.operators import dims
from medlar.operators.dedupe import latest_per_key
from medlar.operators.facts import as_of_join, next_in_sequence, previous_in_sequence

CALENDAR = P.Calendar(1995, 2001)
LAST = CALENDAR.periods - 1
# Statuses by order status, and durations in years by the first character of the priority.
STATUS = {"O": "ENROLLED", "F": "GRADUATED", "P": "DROPPED"}
DURATION = {"1": 2.0, "2": 3.0, "3": 4.0, "4": 2.5, "5": 5.0}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(value: Column, cases: dict) -> Column:
    found = F.lit(None)
    for k, v in cases.items():
        found = F.when(value == k, v).otherwise(found)
    return found


def colleges(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("college_id"), F.col("r_name").alias("college_name"))
    return dims.with_surrogate_key(region, "college_key", ["college_id"])


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five of each college, numbered by id."""
    kinds = F.explode(F.array(*map(F.lit, DURATION)))
    region = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("college_id"), kinds.alias("kind"))
    named = region.select(
        F.format_string("P%d-%s", "college_id", "kind").alias("program_id"), F.format_string("Program %s of college %d", "kind", "college_id").alias("program_name"),
        "college_id", _case(F.col("kind"), DURATION).cast("double").alias("nominal_duration_years"),
    )
    return dims.with_surrogate_key(named, "program_key", ["program_id"])


def students(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("college_id"))
    customer = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return customer.select(
        F.col("c_custkey").alias("student_id"), "college_id", F.when(F.col("c_custkey") % 2 == 0, "Female").otherwise("Male").alias("gender"),
        F.when(F.col("c_mktsegment") == "BUILDING", "Transferee").otherwise("Freshman").alias("admission_type"),
    )


def enrollment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(student_id, period_ordinal) and what the student did in that semester."""
    date = F.col("o_orderdate")
    year, semester = F.year(date), P.semester_of_date(date)
    orders = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("student_id"), year.alias("academic_year"), semester.alias("semester_number"), CALENDAR.ordinal(year, semester).alias("period_ordinal"),
        F.substring("o_orderpriority", 1, 1).alias("kind"), _case(F.col("o_orderstatus"), STATUS).alias("enrollment_status"),
        F.floor(F.col("o_totalprice") / 1000).cast("int").alias("units_enrolled"), "o_orderdate", "o_orderkey",
    )
    orders = orders.repartition("student_id")  # the one shuffle of orders: everything below is by student
    last = latest_per_key(orders, ["student_id", "period_ordinal"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    known = last.join(students(spark, sf_dir).select("student_id", "college_id", "gender", "admission_type"), "student_id")
    turn = F.row_number().over(Window.partitionBy("student_id").orderBy("period_ordinal"))
    known = known.withColumn("turn", turn).withColumn("program_id", F.format_string("P%d-%s", "college_id", "kind"))
    return known.select(
        "student_id", "academic_year", "semester_number", "period_ordinal", "college_id", "program_id", "gender", "admission_type", "enrollment_status", "units_enrolled",
        F.least(F.lit(6), F.floor((F.col("turn") + 1) / 2)).cast("int").alias("year_level"), (F.col("turn") == 1).alias("is_new_enrollee"),
    )


def shifts(enrolled: DataFrame) -> DataFrame:
    """(student_id, period_ordinal, from_program_id, to_program_id) where the program changed since the row before."""
    before = F.lag("program_id").over(Window.partitionBy("student_id").orderBy("period_ordinal"))
    return enrolled.withColumn("from_program_id", before).where("from_program_id <> program_id").select("student_id", "period_ordinal", "from_program_id", F.col("program_id").alias("to_program_id"))


def history(enrolled: DataFrame) -> DataFrame:
    """Spells of programs: (student_id, program_id, valid_from, valid_to, is_current)."""
    entry = latest_per_key(enrolled.select("student_id", "period_ordinal", "program_id"), ["student_id"], [F.col("period_ordinal")])
    return dims.spells(entry, shifts(enrolled), "student_id", "period_ordinal", "program_id", "to_program_id")


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per enrollment with what the composite indicator counts; a student's spell, not the student, is followed."""
    enrolled = enrollment(spark, sf_dir)
    spells = history(enrolled).select("student_id", F.col("valid_from").alias("spell"), "valid_from", "valid_to", "is_current")
    placed = as_of_join(enrolled, spells, "student_id", "period_ordinal")
    durations = programs(spark, sf_dir).select("program_id", "nominal_duration_years")
    placed = placed.join(durations, "program_id", "left")
    who = ["student_id", "spell"]
    following = next_in_sequence(who, "period_ordinal", F.col("enrollment_status"))
    before = previous_in_sequence(who, "period_ordinal", F.col("year_level"))
    counted = (F.col("enrollment_status") != "GRADUATED") & (F.col("period_ordinal") < LAST)
    shifted = F.lag("program_id").over(Window.partitionBy("student_id").orderBy("period_ordinal"))
    return placed.select(
        "college_id", "program_id", "period_ordinal", F.lit(1).alias("enrolled"), (F.col("year_level") >= F.ceil("nominal_duration_years")).cast("int").alias("eligible"),
        (F.col("enrollment_status") == "GRADUATED").cast("int").alias("graduated"), (F.col("enrollment_status") == "DROPPED").cast("int").alias("dropped"),
        F.coalesce((shifted != F.col("program_id")).cast("int"), F.lit(0)).alias("shifted"),
        F.when(counted, F.when(following.isin("ENROLLED", "GRADUATED"), 1).otherwise(0)).alias("retained"),
        F.when(before.isNotNull(), (F.col("year_level") > before).cast("int")).alias("moved_up"),
    )


#: The same entities as common table expressions of other SQL engines.
SQL = """
enr0 AS (
  SELECT o_custkey AS student_id, CAST(year(o_orderdate) AS INTEGER) AS academic_year,
    CAST(CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END AS INTEGER) AS semester_number,
    CAST((year(o_orderdate) - 1995) * 2 + CASE WHEN month(o_orderdate) <= 6 THEN 0 ELSE 1 END AS INTEGER) AS period_ordinal,
    'P' || n_regionkey || '-' || substr(o_orderpriority, 1, 1) AS program_id, n_regionkey AS college_id,
    CASE WHEN o_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 'Transferee' ELSE 'Freshman' END AS admission_type,
    CASE o_orderstatus WHEN 'O' THEN 'ENROLLED' WHEN 'F' THEN 'GRADUATED' WHEN 'P' THEN 'DROPPED' END AS enrollment_status,
    CAST(floor(o_totalprice / 1000) AS INTEGER) AS units_enrolled,
    row_number() OVER (PARTITION BY o_custkey, year(o_orderdate), month(o_orderdate) <= 6 ORDER BY o_orderdate DESC, o_orderkey DESC) AS pick
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
), enr AS (
  SELECT * EXCLUDE (pick), CAST(least(6, (row_number() OVER s + 1) // 2) AS INTEGER) AS year_level, row_number() OVER s = 1 AS is_new_enrollee,
    lag(program_id) OVER s AS from_program_id
  FROM enr0 WHERE pick = 1 WINDOW s AS (PARTITION BY student_id ORDER BY period_ordinal)
), spell AS (
  SELECT student_id, program_id, period_ordinal AS valid_from, lead(period_ordinal) OVER (PARTITION BY student_id ORDER BY period_ordinal) - 1 AS valid_to
  FROM enr WHERE from_program_id IS NULL OR from_program_id <> program_id
), college AS (
  SELECT r_regionkey AS college_id, r_name AS college_name, CAST(row_number() OVER (ORDER BY r_regionkey) AS INTEGER) AS college_key FROM region
), program AS (
  SELECT *, CAST(row_number() OVER (ORDER BY program_id) AS INTEGER) AS program_key FROM (
    SELECT 'P' || r_regionkey || '-' || k AS program_id, 'Program ' || k || ' of college ' || r_regionkey AS program_name, r_regionkey AS college_id, d AS nominal_duration_years
    FROM region, (VALUES ('1', CAST(2.0 AS DOUBLE)), ('2', 3.0), ('3', 4.0), ('4', 2.5), ('5', 5.0)) v(k, d))
), period AS (
  SELECT CAST(i AS INTEGER) AS period_ordinal, CAST(i + 1 AS INTEGER) AS academic_period_key, CAST(1995 + i // 2 AS INTEGER) AS academic_year, CAST(i % 2 + 1 AS INTEGER) AS semester_number,
    (1995 + i // 2) || '-' || (1996 + i // 2) AS year_label, CASE WHEN i % 2 = 0 THEN '1st Semester' ELSE '2nd Semester' END AS semester_label,
    (1995 + i // 2) || '-' || (1996 + i // 2) || ' · ' || CASE WHEN i % 2 = 0 THEN '1st Semester' ELSE '2nd Semester' END AS period_label
  FROM range(14) t(i)
), placed AS (
  SELECT e.*, s.valid_from AS spell, p.nominal_duration_years FROM enr e
  JOIN spell s ON e.student_id = s.student_id AND e.period_ordinal >= s.valid_from AND (s.valid_to IS NULL OR e.period_ordinal <= s.valid_to)
  LEFT JOIN program p ON e.program_id = p.program_id
), measure AS (
  SELECT college_id, program_id, period_ordinal, CAST(year_level >= ceil(nominal_duration_years) AS INTEGER) AS eligible,
    CAST(enrollment_status = 'GRADUATED' AS INTEGER) AS graduated, CAST(enrollment_status = 'DROPPED' AS INTEGER) AS dropped,
    coalesce(CAST(from_program_id <> program_id AS INTEGER), 0) AS shifted,
    CASE WHEN enrollment_status <> 'GRADUATED' AND period_ordinal < 13 THEN
      CASE WHEN lead(period_ordinal) OVER w = period_ordinal + 1 AND lead(enrollment_status) OVER w IN ('ENROLLED', 'GRADUATED') THEN 1 ELSE 0 END END AS retained,
    CASE WHEN lag(period_ordinal) OVER w = period_ordinal - 1 THEN CAST(year_level > lag(year_level) OVER w AS INTEGER) END AS moved_up
  FROM placed WINDOW w AS (PARTITION BY student_id, spell ORDER BY period_ordinal)
), kpi0 AS (
  SELECT college_id, period_ordinal, count(*) AS enrollment_count, CAST(sum(eligible) AS BIGINT) AS eligible_count, CAST(sum(graduated) AS BIGINT) AS graduation_count,
    CAST(sum(dropped) AS BIGINT) AS dropout_count, CAST(sum(shifted) AS BIGINT) AS shifter_count,
    coalesce(avg(CAST(retained AS DOUBLE)), 0.0) AS retention_rate, coalesce(avg(CAST(moved_up AS DOUBLE)), 0.0) AS program_completion_momentum
  FROM measure GROUP BY ALL
), kpi1 AS (
  SELECT college_id, period_ordinal, enrollment_count, graduation_count, dropout_count, shifter_count, retention_rate,
    coalesce(CAST(graduation_count AS DOUBLE) / nullif(eligible_count, 0), 0.0) AS graduation_rate,
    CAST(dropout_count AS DOUBLE) / nullif(enrollment_count, 0) AS dropout_rate, 1 - CAST(shifter_count AS DOUBLE) / nullif(enrollment_count, 0) AS shifter_stability,
    CASE WHEN coalesce(lag(enrollment_count) OVER w, 0) = 0 THEN 1.0::DOUBLE ELSE
      least(greatest(1 - CAST(abs(enrollment_count - lag(enrollment_count) OVER w) AS DOUBLE) / lag(enrollment_count) OVER w, 0.0), 1.0) END AS enrollment_stability,
    program_completion_momentum
  FROM kpi0 WINDOW w AS (PARTITION BY college_id ORDER BY period_ordinal)
), kpi AS (
  SELECT *, round((0.30::DOUBLE * graduation_rate + 0.25::DOUBLE * retention_rate + 0.20::DOUBLE * (1 - dropout_rate) + 0.15::DOUBLE * program_completion_momentum
    + 0.05::DOUBLE * shifter_stability + 0.05::DOUBLE * enrollment_stability) * 100, 1) AS success_rate FROM kpi1
)"""
