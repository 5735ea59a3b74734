"""The library's operators as named queries over the test tables, each with the same query in SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medlar.functions import normalize as N
from medlar.functions import periods as P
from medlar.operators import checks, dedupe, dims, facts, kpi, rules
from medlar.plans import dashboard, reports
from medlar.plans import features as feat
from medlar.plans import forecasting as fc
from medlar.plans import marts
from medlar.plans import gold, silver
from medlar.plans import registrar as R
from medlar.sources import bronze, files, synthetic

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _period(spark: SparkSession) -> DataFrame:
    return dims.academic_periods(spark, R.CALENDAR)


def _kpi(spark: SparkSession, sf: str) -> DataFrame:
    return kpi.institution_kpi(R.measures(spark, sf), ["college_id"], "period_ordinal")


# --- scans and cleaning ---


@query("SELECT l_returnflag, count(*) AS n, sum(CAST(l_quantity AS BIGINT))::BIGINT AS quantity FROM lineitem GROUP BY 1")
def scan_union_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """A table as the union of its partitions."""
    line = R.read(spark, sf, "lineitem").select("l_returnflag", "l_quantity")
    parts = [line.where(F.col("l_returnflag") == f) for f in ("A", "N", "R")]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2], allowMissingColumns=True)
    return whole.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


_RAW_STATUS = """CASE o_orderkey % 7 WHEN 0 THEN 'ENROLLED' WHEN 1 THEN ' enrolled ' WHEN 2 THEN 'Graduated' WHEN 3 THEN 'dropped out'
  WHEN 4 THEN 'SUSPENDED' WHEN 5 THEN ' Dropped' ELSE NULL END"""


def _raw_status() -> F.Column:
    return F.expr(_RAW_STATUS)


@query(f"""SELECT raw, status, count(*) AS n FROM (SELECT raw, CASE WHEN raw IS NULL THEN NULL
  WHEN upper(trim(raw)) IN ('ENROLLED', 'GRADUATED', 'DROPPED') THEN upper(trim(raw)) WHEN upper(trim(raw)) = 'DROPPED OUT' THEN 'DROPPED'
  ELSE 'UNKNOWN:' || raw END AS status FROM (SELECT {_RAW_STATUS} AS raw FROM orders)) GROUP BY ALL""")
def normalize_status(spark: SparkSession, sf: str) -> DataFrame:
    raw = R.read(spark, sf, "orders").select(_raw_status().alias("raw"))
    return raw.select("raw", N.status(F.col("raw")).alias("status")).groupBy("raw", "status").agg(F.count("*").alias("n"))


@query("""SELECT segment, count(*) AS n FROM (SELECT CASE upper(trim(raw)) WHEN 'BUILDING' THEN 'Building' WHEN 'MACHINERY' THEN 'Machinery'
  WHEN 'HOUSEHOLD' THEN 'Household' ELSE 'UNKNOWN:' || raw END AS segment
  FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN ' ' || lower(c_mktsegment) ELSE c_mktsegment END AS raw FROM customer)) GROUP BY 1""")
def normalize_categorical(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), F.lower("c_mktsegment"))).otherwise(F.col("c_mktsegment"))
    named = N.category(raw, ["Building", "Machinery", "Household"])
    return R.read(spark, sf, "customer").select(named.alias("segment")).groupBy("segment").agg(F.count("*").alias("n"))


@query("""SELECT start_year, semester, period_start, label, count(*) AS n FROM (SELECT y AS start_year,
  CASE s % 4 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '1' ELSE '3rd Term' END AS semester,
  make_date(y, CASE WHEN s % 2 = 1 THEN 7 ELSE 1 END, 1) AS period_start,
  y || '-' || (y + 1) || ' · ' || CASE WHEN s % 2 = 0 THEN '1st Semester' ELSE '2nd Semester' END AS label
  FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS y, o_orderkey % 4 AS s FROM orders)) GROUP BY ALL""")
def normalize_period_label(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("o_orderkey") % 4
    raw = R.read(spark, sf, "orders").select(
        P.year_label(F.year("o_orderdate")).alias("year_raw"), F.when(s == 0, "1").when(s == 1, " 2nd semester").when(s == 2, "1ST").otherwise("3rd Term").alias("semester_raw"), s.alias("s")
    )
    half = F.when(F.col("s") % 2 == 1, 2).otherwise(1)
    year = P.start_year(F.col("year_raw"))
    made = raw.select(year.alias("start_year"), N.semester(F.col("semester_raw")).alias("semester"), P.period_start(year, half).alias("period_start"), P.period_label(year, half).alias("label"))
    return made.groupBy(*made.columns).agg(F.count("*").alias("n"))


@query("""SELECT event_type, count(*) AS n, count(cleaned) AS kept FROM (SELECT event_type,
  nullif(trim(CASE WHEN event_id % 3 = 0 THEN '   ' WHEN event_id % 3 = 1 THEN '  ' || event_type ELSE event_type END), '') AS cleaned FROM events) GROUP BY 1""")
def nullify_text(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 3
    raw = F.when(k == 0, "   ").when(k == 1, F.concat(F.lit("  "), "event_type")).otherwise(F.col("event_type"))
    return R.read(spark, sf, "events").select("event_type", N.nullify(raw).alias("cleaned")).groupBy("event_type").agg(F.count("*").alias("n"), F.count("cleaned").alias("kept"))


@query("""WITH raw AS (SELECT CASE event_id % 4 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN user_id || '.0' WHEN 2 THEN user_id || 'x' ELSE NULL END AS t FROM events),
  cast_ AS (SELECT t, CASE WHEN try_cast(t AS DOUBLE) = floor(try_cast(t AS DOUBLE)) THEN CAST(try_cast(t AS DOUBLE) AS BIGINT) END AS v FROM raw)
  SELECT count(*) AS n, count(v) AS converted, count(*) FILTER (t IS NOT NULL AND v IS NULL) AS failures, sum(v)::BIGINT AS total FROM cast_""")
def coerce_types_with_failures(spark: SparkSession, sf: str) -> DataFrame:
    k, user = F.col("event_id") % 4, F.col("user_id").cast("string")
    raw = F.when(k == 0, user).when(k == 1, F.concat(user, F.lit(".0"))).when(k == 2, F.concat(user, F.lit("x")))
    made = R.read(spark, sf, "events").select(raw.alias("t")).withColumn("v", N.whole_number(F.col("t")))
    return made.agg(F.count("*").alias("n"), F.count("v").alias("converted"), F.count(F.when(N.lost(F.col("t"), F.col("v")), 1)).alias("failures"), F.sum("v").alias("total"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag, max(batch) AS batch FROM (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag, CAST(1 AS INTEGER) AS batch FROM lineitem
  UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag, 2 FROM lineitem WHERE l_orderkey % 5 = 0) GROUP BY ALL""")
def exact_dup_collapse(spark: SparkSession, sf: str) -> DataFrame:
    line = R.read(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")
    landed = line.withColumn("batch", F.lit(1)).unionByName(line.where("l_orderkey % 5 = 0").withColumn("batch", F.lit(2)))
    return dedupe.collapse_copies(landed, ["batch"], "batch")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS r FROM lineitem) WHERE r = 1""")
def dedupe_last_write_wins(spark: SparkSession, sf: str) -> DataFrame:
    line = R.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    return dedupe.last_write_wins(line, ["l_orderkey", "l_linenumber"], "l_shipdate")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.copies(R.read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


# --- rules ---


@query(f"""SELECT coalesce(CASE WHEN status LIKE 'UNKNOWN:%' THEN 'known_status' END, 'valid') AS outcome, count(*) AS n FROM (SELECT CASE WHEN raw IS NULL THEN NULL
  WHEN upper(trim(raw)) IN ('ENROLLED', 'GRADUATED', 'DROPPED', 'DROPPED OUT') THEN 'ok' ELSE 'UNKNOWN:' || raw END AS status FROM (SELECT {_RAW_STATUS} AS raw FROM orders)) GROUP BY 1""")
def known_status_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.read(spark, sf, "orders").select(N.status(_raw_status()).alias("status"))
    tagged = rules.tag(rows, [rules.Rule("known_status", ~N.is_unknown(F.col("status")))])
    return tagged.groupBy(F.coalesce(rules.FAILED, F.lit("valid")).alias("outcome")).agg(F.count("*").alias("n"))


@query(f"""WITH {R.SQL}, entry AS (SELECT student_id, CAST(1995 + student_id % 4 AS INTEGER) AS cohort FROM (SELECT c_custkey AS student_id FROM customer WHERE c_custkey % 10 <> 0))
  SELECT e.college_id, count(*) AS n, count(*) FILTER (cohort IS NOT NULL AND period_ordinal BETWEEN (cohort - 1995) * 2 AND 13) AS valid
  FROM enr e LEFT JOIN entry USING (student_id) GROUP BY 1""")
def cohort_range_check(spark: SparkSession, sf: str) -> DataFrame:
    """Enrollment before a student's entry, and of unknown students, fails."""
    entry = R.read(spark, sf, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("student_id"), (F.lit(1995) + F.col("c_custkey") % 4).cast("int").alias("cohort"))
    met = R.enrollment(spark, sf).join(entry, "student_id", "left")
    begin = R.CALENDAR.ordinal(F.col("cohort"), F.lit(1))
    tagged = rules.tag(met, [rules.Rule("cohort_range", F.col("period_ordinal").between(begin, F.lit(R.LAST)))])
    return tagged.groupBy("college_id").agg(F.count("*").alias("n"), F.count(F.when(F.col(rules.FAILED).isNull(), 1)).alias("valid"))


@query(f"""WITH {R.SQL}, ev AS (SELECT DISTINCT student_id, period_ordinal FROM enr WHERE enrollment_status = 'DROPPED' AND student_id % 7 <> 0
    UNION SELECT student_id, period_ordinal FROM enr WHERE enrollment_status = 'ENROLLED' AND student_id % 11 = 0)
  SELECT enrollment_status, count(*) AS n, count(*) FILTER ((ev.student_id IS NOT NULL) = (enrollment_status = 'DROPPED')) AS consistent
  FROM enr e LEFT JOIN ev ON e.student_id = ev.student_id AND e.period_ordinal = ev.period_ordinal GROUP BY 1""")
def event_biconditional(spark: SparkSession, sf: str) -> DataFrame:
    """A dropout event exists exactly where the enrollment says dropped."""
    enrolled = R.enrollment(spark, sf)
    key = ["student_id", "period_ordinal"]
    events = enrolled.where("enrollment_status = 'DROPPED' AND student_id % 7 <> 0").select(*key).union(enrolled.where("enrollment_status = 'ENROLLED' AND student_id % 11 = 0").select(*key))
    met = rules.with_flag(enrolled, events, key, "has_event")
    consistent = F.col("has_event") == (F.col("enrollment_status") == "DROPPED")
    return met.groupBy("enrollment_status").agg(F.count("*").alias("n"), F.count(F.when(consistent, 1)).alias("consistent"))


@query(f"""WITH {R.SQL} SELECT e.college_id, count(*) AS n, count(*) FILTER (p.college_id IS NULL OR p.college_id <> (e.college_id + CASE WHEN student_id % 13 = 0 THEN 1 ELSE 0 END)) AS failed
  FROM enr e LEFT JOIN program p ON p.program_id = CASE WHEN student_id % 17 = 0 THEN 'P?' ELSE e.program_id END GROUP BY 1""")
def ref_consistency(spark: SparkSession, sf: str) -> DataFrame:
    """A program must exist and belong to the row's college."""
    enrolled = R.enrollment(spark, sf).withColumn("program_id", F.when(F.col("student_id") % 17 == 0, "P?").otherwise(F.col("program_id")))
    enrolled = enrolled.withColumn("claimed", F.col("college_id") + F.when(F.col("student_id") % 13 == 0, 1).otherwise(0))
    owner = R.programs(spark, sf).select("program_id", F.col("college_id").alias("owner"))
    tagged = rules.tag(enrolled.join(owner, "program_id", "left"), [rules.Rule("program_college", F.col("owner") == F.col("claimed"))])
    return tagged.groupBy("college_id").agg(F.count("*").alias("n"), F.count(rules.FAILED).alias("failed"))


@query(f"""WITH {R.SQL} SELECT p.program_id, count(*) AS n, count(*) FILTER (year_level NOT BETWEEN 1 AND ceil(nominal_duration_years) + 1) AS failed
  FROM enr e JOIN program p USING (program_id) GROUP BY 1""")
def bound_check(spark: SparkSession, sf: str) -> DataFrame:
    """A year level lies within the program's duration and a buffer."""
    met = R.enrollment(spark, sf).join(R.programs(spark, sf).select("program_id", "nominal_duration_years"), "program_id", "left")
    tagged = rules.tag(met, [rules.Rule("year_level", F.col("year_level").between(F.lit(1), F.ceil("nominal_duration_years") + 1))])
    return tagged.groupBy("program_id").agg(F.count("*").alias("n"), F.count(rules.FAILED).alias("failed"))


@query("""SELECT c_mktsegment, count(*) AS n, count(*) FILTER (bal IS NULL OR bal >= 0) AS valid FROM (
  SELECT c_mktsegment, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal END AS bal FROM customer) GROUP BY 1""")
def non_negative(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.read(spark, sf, "customer").select("c_mktsegment", F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal")).alias("bal"))
    tagged = rules.tag(rows, [rules.Rule("non_negative", rules.non_negative(rows, ["bal", "absent"]))])
    return tagged.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count(F.when(F.col(rules.FAILED).isNull(), 1)).alias("valid"))


@query("""SELECT c_nationkey, count(*) AS applicants, CAST(sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) AS BIGINT) AS accepted,
  CAST(sum(CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END) + CASE WHEN c_nationkey % 6 = 0 THEN 1000000 ELSE 0 END AS BIGINT) AS enrolled, c_nationkey % 6 <> 0 AS is_funnel FROM customer GROUP BY c_nationkey""")
def funnel_check(spark: SparkSession, sf: str) -> DataFrame:
    bal = F.col("c_acctbal")
    counted = R.read(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("applicants"), F.count(F.when(bal > 0, 1)).alias("accepted"), F.count(F.when(bal > 5000, 1)).alias("enrolled"))
    counted = counted.withColumn("enrolled", F.col("enrolled") + F.when(F.col("c_nationkey") % 6 == 0, 1_000_000).otherwise(0))
    return counted.withColumn("is_funnel", rules.funnel("applicants", "accepted", "enrolled"))


def _chain(spark: SparkSession, sf: str) -> tuple[DataFrame, list[rules.Rule]]:
    rows = R.enrollment(spark, sf).withColumn("enrollment_status", F.when(F.col("student_id") % 19 == 0, "UNKNOWN:X").otherwise(F.col("enrollment_status")))
    chain = [
        rules.Rule("known_status", ~N.is_unknown(F.col("enrollment_status"))),
        rules.Rule("cohort_range", F.col("period_ordinal") >= F.col("student_id") % 3),
        rules.Rule("units", F.col("units_enrolled") <= 300),
    ]
    return rules.tag(rows, chain), chain


_CHAIN = f"""WITH {R.SQL}, t AS (SELECT CASE WHEN student_id % 19 = 0 THEN 'known_status' WHEN period_ordinal < student_id % 3 THEN 'cohort_range'
  WHEN units_enrolled > 300 THEN 'units' END AS failed_rule FROM enr)"""


@query(f"{_CHAIN} SELECT failed_rule, count(*) AS n FROM t GROUP BY 1")
def first_failed_rule_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rules.tally(_chain(spark, sf)[0])


@query(f"""{_CHAIN}, g AS (SELECT 'known_status' AS rule, count(*) AS checked, count(*) FILTER (failed_rule = 'known_status') AS failed FROM t
  UNION ALL SELECT 'cohort_range', count(*) FILTER (failed_rule IS NULL OR failed_rule <> 'known_status'), count(*) FILTER (failed_rule = 'cohort_range') FROM t
  UNION ALL SELECT 'units', count(*) FILTER (failed_rule IS NULL OR failed_rule = 'units'), count(*) FILTER (failed_rule = 'units') FROM t)
  SELECT rule, checked, failed, CAST(failed AS DOUBLE) / checked AS share, CAST(failed AS DOUBLE) / checked <= 0.25 AS passed FROM g""")
def quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    tagged, chain = _chain(spark, sf)
    return rules.gate_report(tagged, chain)


@query(f"""WITH {R.SQL}, l AS (SELECT student_id, period_ordinal, CAST(1 + (student_id * 7 + period_ordinal * 3) % 4 AS INTEGER) AS lvl FROM enr)
  SELECT student_id, period_ordinal, lvl FROM (SELECT *, lag(lvl) OVER w AS pl, lag(period_ordinal) OVER w AS po FROM l WINDOW w AS (PARTITION BY student_id ORDER BY period_ordinal))
  WHERE po = period_ordinal - 1 AND (lvl < pl OR lvl > pl + 1)""")
def illegal_transitions(spark: SparkSession, sf: str) -> DataFrame:
    level = (1 + (F.col("student_id") * 7 + F.col("period_ordinal") * 3) % 4).cast("int")
    rows = R.enrollment(spark, sf).select("student_id", "period_ordinal", level.alias("lvl"))
    return facts.illegal_transitions(rows, "student_id", "period_ordinal", "lvl").where("is_illegal").drop("is_illegal")


def _landed(spark: SparkSession, sf: str) -> DataFrame:
    """Enrollment as text with noise, some of it landed twice."""
    k = F.col("student_id") % 7
    rows = R.enrollment(spark, sf)
    text = rows.select(
        F.col("student_id").cast("string").alias("student_id"), P.year_label(F.col("academic_year")).alias("academic_year"),
        F.when(k == 0, P.semester_label(F.col("semester_number"))).when(k == 1, "term").otherwise(F.col("semester_number").cast("string")).alias("semester_number"),
        F.col("college_id").cast("string").alias("college_id"), "program_id", F.when(k == 2, F.lower("enrollment_status")).when(k == 3, "ON LEAVE").otherwise(F.col("enrollment_status")).alias("enrollment_status"),
        F.when(k == 4, F.concat("year_level", F.lit(".0"))).when(k == 5, "?").otherwise(F.col("year_level").cast("string")).alias("year_level"),
        F.col("units_enrolled").cast("string").alias("units_enrolled"), F.col("is_new_enrollee").cast("string").alias("is_new_enrollee"), F.lit(1).alias("_ingested_at"),
    )
    return text.union(text.where("student_id % 10 = 0").withColumn("_ingested_at", F.lit(2)))


@query(f"""WITH {R.SQL}, t AS (SELECT student_id % 7 AS k, student_id, 1 AS c FROM enr UNION ALL SELECT student_id % 7, student_id, 2 FROM enr WHERE student_id % 10 = 0)
  SELECT count(*) AS rows, count(*) FILTER (k = 3) AS unknown_status, CAST(0 AS BIGINT) AS unknown_category, count(*) FILTER (k = 1) + count(*) FILTER (k = 5) AS coercion_failures,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT student_id, academic_year, CASE WHEN student_id % 7 = 1 THEN NULL ELSE semester_number END, program_id, CASE WHEN student_id % 7 = 3 THEN 'x' ELSE enrollment_status END,
    CASE WHEN student_id % 7 = 5 THEN NULL ELSE year_level END, units_enrolled, is_new_enrollee FROM enr)) AS duplicates_dropped FROM t""")
def clean_entity_stats(spark: SparkSession, sf: str) -> DataFrame:
    return silver.clean(_landed(spark, sf), "enrollment").stats


def _validated(spark: SparkSession, sf: str) -> DataFrame:
    enrolled = R.enrollment(spark, sf).withColumn("enrollment_status", F.when(F.col("student_id") % 19 == 0, "UNKNOWN:X").otherwise(F.col("enrollment_status")))
    enrolled = enrolled.withColumn("year_level", (1 + (F.col("student_id") * 7 + F.col("period_ordinal") * 3) % 4).cast("int")).drop("period_ordinal")
    students = R.students(spark, sf).select("student_id", (F.lit(1995) + F.col("student_id") % 3).cast("int").alias("cohort_academic_year"))
    events = enrolled.where("enrollment_status = 'DROPPED' AND student_id % 7 <> 0").select("student_id", "academic_year", "semester_number")
    return silver.validate_enrollment(enrolled, students, events, R.CALENDAR)


@query(f"""WITH {R.SQL}, t AS (SELECT student_id, period_ordinal, 1 + (student_id * 7 + period_ordinal * 3) % 4 AS lvl, CASE WHEN student_id % 19 = 0 THEN 'known_status'
    WHEN period_ordinal < (student_id % 3) * 2 THEN 'cohort_range' WHEN enrollment_status = 'DROPPED' AND student_id % 7 = 0 THEN 'dropout_event' END AS r FROM enr),
  s AS (SELECT *, lag(lvl) OVER w AS pl, lag(period_ordinal) OVER w AS po FROM t WHERE r IS NULL WINDOW w AS (PARTITION BY student_id ORDER BY period_ordinal)),
  f AS (SELECT r FROM t WHERE r IS NOT NULL UNION ALL SELECT CASE WHEN po = period_ordinal - 1 AND (lvl < pl OR lvl > pl + 1) THEN 'progression' END FROM s)
  SELECT r AS failed_rule, count(*) AS n FROM f GROUP BY 1""")
def validation_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Rules in order; progression is judged on what passed the others."""
    return rules.tally(_validated(spark, sf))


@query(f"""WITH {R.SQL}, t AS (SELECT CASE WHEN NOT (academic_year BETWEEN 1995 AND 2000) THEN 'academic_year' WHEN e.college_id <> p.college_id + CASE WHEN student_id % 13 = 0 THEN 1 ELSE 0 END THEN 'program_college'
    WHEN year_level > ceil(nominal_duration_years) + 2 THEN 'year_level' WHEN units_enrolled - 5 < 0 THEN 'non_negative' END AS r FROM enr e JOIN program p USING (program_id)),
  n(i, rule) AS (VALUES (0, 'semester_number'), (1, 'academic_year'), (2, 'program_college'), (3, 'year_level'), (4, 'non_negative')),
  j AS (SELECT coalesce(n.i, 5) AS i FROM t LEFT JOIN n ON n.rule = t.r)
  SELECT rule, count(*) FILTER (j.i >= n.i) AS checked, count(*) FILTER (j.i = n.i) AS failed, coalesce(CAST(count(*) FILTER (j.i = n.i) AS DOUBLE) / nullif(count(*) FILTER (j.i >= n.i), 0), 0) AS share,
  coalesce(CAST(count(*) FILTER (j.i = n.i) AS DOUBLE) / nullif(count(*) FILTER (j.i >= n.i), 0), 0) <= 0.25 AS passed FROM n, j GROUP BY 1""")
def business_rule_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.enrollment(spark, sf).withColumn("college_id", F.col("college_id") - F.when(F.col("student_id") % 13 == 0, 1).otherwise(0)).withColumn("units_enrolled", F.col("units_enrolled") - 5)
    programs = R.programs(spark, sf)
    return rules.gate_report(*silver.business_rules("enrollment", rows, programs, R.colleges(spark, sf), P.Calendar(1995, 2000)))


def _silver(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    enrolled = R.enrollment(spark, sf)
    first = dedupe.latest_per_key(enrolled, ["student_id"], [F.col("period_ordinal")])
    period = ["academic_year", "semester_number"]
    student = first.select("student_id", F.lit(1995).alias("cohort_academic_year"), F.col("college_id").alias("entry_college_id"), F.col("program_id").alias("entry_program_id"), "gender", "admission_type", F.lit(None).cast("string").alias("home_province"), F.lit(None).cast("int").alias("birth_year"))
    moved = R.shifts(enrolled).join(enrolled.select("student_id", "period_ordinal", *period), ["student_id", "period_ordinal"]).drop("period_ordinal")
    ended = lambda s, *more: enrolled.where(F.col("enrollment_status") == s).select("student_id", *period, "college_id", "program_id", *more)
    return {
        "college": R.colleges(spark, sf).drop("college_key"), "program": R.programs(spark, sf).drop("program_key").withColumn("program_level", F.lit("Bachelor")), "student": student,
        "enrollment": enrolled.drop("period_ordinal", "gender", "admission_type"), "shifter": moved, "graduation": ended("GRADUATED", F.lit(4.0).alias("years_to_complete")),
        "dropout": ended("DROPPED", F.lit("unknown").alias("dropout_reason"), F.lit(0).alias("semesters_completed_before_dropout")),
    }


@query(f"""WITH {R.SQL} SELECT 'fact_enrollment' AS name, count(*) AS n FROM enr UNION ALL SELECT 'fact_graduation', count(*) FROM enr WHERE enrollment_status = 'GRADUATED'
  UNION ALL SELECT 'fact_dropout', count(*) FROM enr WHERE enrollment_status = 'DROPPED' UNION ALL SELECT 'fact_shifter', count(*) FROM enr WHERE from_program_id <> program_id
  UNION ALL SELECT 'fact_retention', count(*) FROM enr WHERE enrollment_status <> 'GRADUATED' AND period_ordinal < 13
  UNION ALL SELECT 'fact_institution_kpi', count(*) FROM (SELECT DISTINCT college_id, period_ordinal FROM enr) UNION ALL SELECT 'dim_student', count(*) FROM spell""")
def star_schema_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The whole star schema, reconciled by row counts."""
    made = gold.build(spark, _silver(spark, sf), R.CALENDAR)
    whole = None
    for name in ("fact_enrollment", "fact_graduation", "fact_dropout", "fact_shifter", "fact_retention", "fact_institution_kpi", "dim_student"):
        one = made[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        whole = one if whole is None else whole.union(one)
    return whole


# --- dimensions and facts ---


@query(f"WITH {R.SQL} SELECT academic_period_key, academic_year, semester_number, period_ordinal, year_label, semester_label, period_label FROM period")
def dim_period(spark: SparkSession, sf: str) -> DataFrame:
    return _period(spark)


@query("""SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, CAST(d AS DATE) AS full_date, CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter,
  CAST(month(d) AS INTEGER) AS month, CAST(day(d) AS INTEGER) AS day, CAST((year(d) - 1995) * 2 + CASE WHEN month(d) <= 6 THEN 0 ELSE 1 END AS INTEGER) AS period_ordinal,
  strftime(d, '%m-%d') IN ('01-01', '07-01') AS is_semester_start, strftime(d, '%m-%d') IN ('06-30', '12-31') AS is_semester_end
  FROM range(DATE '1995-01-01', DATE '2002-01-01', INTERVAL 1 DAY) t(d)""")
def dim_calendar(spark: SparkSession, sf: str) -> DataFrame:
    return dims.calendar_days(spark, R.CALENDAR)


@query("SELECT * FROM (VALUES (CAST(1 AS INTEGER), 'Female'), (2, 'Male')) v(gender_key, gender_label)")
def dim_gender(spark: SparkSession, sf: str) -> DataFrame:
    return dims.vocabulary(spark, "gender_key", "gender_label", ["Female", "Male"])


@query(f"WITH {R.SQL} SELECT program_id, program_name, college_id, nominal_duration_years, program_key FROM program")
def dim_surrogate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return R.programs(spark, sf)


@query(f"WITH {R.SQL} SELECT student_id, program_id, valid_from, CAST(valid_to AS INTEGER) AS valid_to, valid_to IS NULL AS is_current FROM spell")
def scd2_spells(spark: SparkSession, sf: str) -> DataFrame:
    return R.history(R.enrollment(spark, sf))


@query(f"""WITH {R.SQL} SELECT e.student_id, e.period_ordinal, e.program_id AS enrolled_program, s.program_id AS program_as_of FROM enr e
  JOIN spell s ON e.student_id = s.student_id AND e.period_ordinal >= s.valid_from AND (s.valid_to IS NULL OR e.period_ordinal <= s.valid_to)""")
def asof_join(spark: SparkSession, sf: str) -> DataFrame:
    enrolled = R.enrollment(spark, sf)
    spells = R.history(enrolled).withColumnRenamed("program_id", "program_as_of")
    return facts.as_of_join(enrolled.select("student_id", "period_ordinal", F.col("program_id").alias("enrolled_program")), spells, "student_id", "period_ordinal")


@query(f"""WITH {R.SQL}, h AS (SELECT * FROM spell WHERE student_id % 5 <> 0) SELECT count(*) AS n, CAST(coalesce(sum(units_enrolled), 0) AS BIGINT) AS units FROM enr e
  WHERE NOT EXISTS (SELECT 1 FROM h s WHERE e.student_id = s.student_id AND e.period_ordinal >= s.valid_from AND (s.valid_to IS NULL OR e.period_ordinal <= s.valid_to))""")
def asof_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    enrolled = R.enrollment(spark, sf)
    lost = facts.outside_history(enrolled, R.history(enrolled).where("student_id % 5 <> 0"), "student_id", "period_ordinal")
    return lost.agg(F.count("*").alias("n"), F.coalesce(F.sum("units_enrolled"), F.lit(0)).alias("units"))


def _keyed_facts(spark: SparkSession, sf: str) -> DataFrame:
    program = F.when(F.col("student_id") % 23 == 0, "P?").otherwise(F.col("program_id"))
    rows = R.enrollment(spark, sf).select("student_id", "period_ordinal", "college_id", program.alias("program_id"))
    rows = facts.resolve(rows, R.colleges(spark, sf), ["college_id"], "college_key")
    rows = facts.resolve(rows, R.programs(spark, sf), ["program_id"], "program_key")
    return facts.resolve(rows, _period(spark), ["period_ordinal"], "academic_period_key")


_KEYED = f"""WITH {R.SQL}, f AS (SELECT student_id, college_key, program_key, academic_period_key FROM (SELECT student_id, period_ordinal, college_id,
  CASE WHEN student_id % 23 = 0 THEN 'P?' ELSE program_id END AS program_id FROM enr) e LEFT JOIN college c USING (college_id) LEFT JOIN program p USING (program_id) LEFT JOIN period USING (period_ordinal))"""


@query(f"{_KEYED} SELECT student_id, college_key, program_key, academic_period_key FROM f")
def fact_with_key_resolution(spark: SparkSession, sf: str) -> DataFrame:
    return _keyed_facts(spark, sf).select("student_id", "college_key", "program_key", "academic_period_key")


@query(f"""{_KEYED} SELECT 'college_key' AS key, count(*) - count(college_key) AS missing FROM f UNION ALL SELECT 'program_key', count(*) - count(program_key) FROM f
  UNION ALL SELECT 'academic_period_key', count(*) - count(academic_period_key) FROM f""")
def unresolved_key_count(spark: SparkSession, sf: str) -> DataFrame:
    return facts.unresolved(_keyed_facts(spark, sf), ["college_key", "program_key", "academic_period_key"])


@query(f"""WITH {R.SQL} SELECT e.student_id, e.period_ordinal, CAST(CASE WHEN n.enrollment_status IN ('ENROLLED', 'GRADUATED') THEN 1 ELSE 0 END AS INTEGER) AS is_retained
  FROM enr e LEFT JOIN enr n ON n.student_id = e.student_id AND n.period_ordinal = e.period_ordinal + 1 WHERE e.enrollment_status <> 'GRADUATED' AND e.period_ordinal < 13""")
def retention_next_period(spark: SparkSession, sf: str) -> DataFrame:
    return facts.retention(R.enrollment(spark, sf), "student_id", "period_ordinal", "enrollment_status", R.LAST).select("student_id", "period_ordinal", "is_retained")


@query(f"""WITH {R.SQL} SELECT c.college_id, c.period_ordinal, avg(CASE WHEN c.year_level > p.year_level THEN 1.0::DOUBLE ELSE 0.0 END) AS momentum
  FROM enr c JOIN enr p ON c.student_id = p.student_id AND c.period_ordinal = p.period_ordinal + 1 GROUP BY 1, 2""")
def momentum_prev_period(spark: SparkSession, sf: str) -> DataFrame:
    before = facts.previous_in_sequence("student_id", "period_ordinal", F.col("year_level"))
    rows = R.enrollment(spark, sf).withColumn("before", before).where("before IS NOT NULL")
    return rows.groupBy("college_id", "period_ordinal").agg(F.avg(F.when(F.col("year_level") > F.col("before"), 1.0).otherwise(0.0)).alias("momentum"))


@query(f"""WITH {R.SQL} SELECT f.college_id AS from_college, s.from_program_id, s.program_id AS to_program_id, count(*) AS shifts
  FROM enr s JOIN program f ON s.from_program_id = f.program_id JOIN program t ON s.program_id = t.program_id WHERE s.from_program_id <> s.program_id GROUP BY ALL""")
def role_playing_programs(spark: SparkSession, sf: str) -> DataFrame:
    program = R.programs(spark, sf)
    origin = program.select(F.col("program_id").alias("from_program_id"), F.col("college_id").alias("from_college"))
    target = program.select(F.col("program_id").alias("to_program_id"))
    moved = R.shifts(R.enrollment(spark, sf)).join(origin, "from_program_id").join(target, "to_program_id")
    return moved.groupBy("from_college", "from_program_id", "to_program_id").agg(F.count("*").alias("shifts"))


# --- indicator and marts ---

_KPI_COLUMNS = """enrollment_count, graduation_count, dropout_count, shifter_count, retention_rate, graduation_rate, dropout_rate,
  shifter_stability, enrollment_stability, program_completion_momentum, success_rate"""


@query(f"WITH {R.SQL} SELECT college_id, period_ordinal, {_KPI_COLUMNS} FROM kpi")
def institution_kpi(spark: SparkSession, sf: str) -> DataFrame:
    return _kpi(spark, sf)


@query(f"WITH {R.SQL} SELECT kpi.college_id, college_name, college_key, kpi.period_ordinal, period_label, academic_year, semester_number, {_KPI_COLUMNS} FROM kpi JOIN college USING (college_id) JOIN period USING (period_ordinal)")
def mart_kpi_labels(spark: SparkSession, sf: str) -> DataFrame:
    return marts.labelled_kpi(_kpi(spark, sf), R.colleges(spark, sf), _period(spark))


@query(f"""WITH {R.SQL} SELECT college_id, period_ordinal, success_rate, round(avg(success_rate) OVER (PARTITION BY period_ordinal), 6) AS campus_avg,
  round(success_rate - avg(success_rate) OVER (PARTITION BY period_ordinal), 6) AS vs_campus_avg FROM kpi""")
def mart_benchmark_vs_avg(spark: SparkSession, sf: str) -> DataFrame:
    made = marts.against_average(_kpi(spark, sf).select("college_id", "period_ordinal", "success_rate"), "success_rate", "period_ordinal")
    return made.withColumn("campus_avg", F.round("campus_avg", 6)).withColumn("vs_campus_avg", F.round("vs_campus_avg", 6))


@query(f"""WITH {R.SQL} SELECT period_ordinal, CAST(sum(enrollment_count) AS BIGINT) AS total_enrollment, CAST(sum(graduation_count) AS BIGINT) AS total_graduates,
  CAST(sum(dropout_count) AS BIGINT) AS total_dropouts, round(CAST(sum(dropout_count) AS DOUBLE) / nullif(sum(enrollment_count), 0), 6) AS overall_dropout_rate,
  round(sum(enrollment_count * retention_rate) / nullif(sum(enrollment_count), 0), 6) AS overall_retention_rate,
  round(sum(enrollment_count * success_rate) / nullif(sum(enrollment_count), 0), 6) AS overall_success_rate FROM kpi GROUP BY 1""")
def mart_exec_weighted(spark: SparkSession, sf: str) -> DataFrame:
    made = marts.executive_summary(_kpi(spark, sf), ["period_ordinal"])
    return made.select(*[F.round(c, 6).alias(c) if c.startswith("overall") else F.col(c) for c in made.columns])


@query(f"""WITH {R.SQL} SELECT m.program_id, period_ordinal, count(*) AS enrollment_count, CAST(sum(graduated) AS BIGINT) AS graduation_count, CAST(sum(dropped) AS BIGINT) AS dropout_count,
  CAST(sum(dropped) AS DOUBLE) / count(*) AS dropout_rate, any_value(program_name) AS program_name, any_value(p.college_id) AS college_id, any_value(nominal_duration_years) AS nominal_duration_years,
  any_value(program_key) AS program_key, any_value(period_label) AS period_label, any_value(academic_year) AS academic_year
  FROM measure m JOIN program p USING (program_id) JOIN period USING (period_ordinal) GROUP BY 1, 2""")
def mart_program_perf(spark: SparkSession, sf: str) -> DataFrame:
    return marts.program_performance(R.measures(spark, sf), R.programs(spark, sf), _period(spark))


@query(f"""WITH {R.SQL}, r AS (SELECT program_id, period_ordinal, avg(CAST(retained AS DOUBLE)) AS retention_rate FROM measure WHERE retained IS NOT NULL GROUP BY 1, 2),
  l AS (SELECT *, lag(retention_rate, 1) OVER w AS p1, lag(retention_rate, 2) OVER w AS p2 FROM r WINDOW w AS (PARTITION BY program_id ORDER BY period_ordinal))
  SELECT program_id, period_ordinal, period_label, retention_rate, p1 AS retention_rate_prev1, p2 AS retention_rate_prev2, retention_rate < p1 AND p1 < p2 AS is_declining_twice
  FROM l JOIN period USING (period_ordinal) WHERE p2 IS NOT NULL""")
def mart_retention_risk(spark: SparkSession, sf: str) -> DataFrame:
    made = marts.retention_risk(R.measures(spark, sf), R.programs(spark, sf), _period(spark))
    return made.select("program_id", "period_ordinal", "period_label", "retention_rate", "retention_rate_prev1", "retention_rate_prev2", "is_declining_twice")


@query(f"""WITH {R.SQL}, named AS (SELECT year_label AS academic_year, semester_label AS semester, college_name AS college, program_name AS program, gender,
    CASE WHEN year_level <= 1 THEN 'Freshman' WHEN year_level = 2 THEN 'Sophomore' WHEN year_level = 3 THEN 'Junior' WHEN year_level = 4 THEN 'Senior'
      WHEN year_level > ceil(nominal_duration_years) THEN 'Super Senior' ELSE 'Senior' END AS year_level, enrollment_status, is_new_enrollee, admission_type
    FROM enr JOIN college USING (college_id) JOIN program USING (program_id) JOIN period USING (period_ordinal)),
  base AS (SELECT academic_year, semester, college, program, gender, year_level, CAST(sum(CASE WHEN is_new_enrollee AND admission_type = 'Freshman' THEN 1 ELSE 0 END) AS BIGINT) AS freshmen_count,
    count(*) AS enrolled FROM named GROUP BY ALL),
  ended AS (SELECT academic_year, semester, college, program, gender, count(*) FILTER (enrollment_status = 'GRADUATED') AS graduates, count(*) FILTER (enrollment_status = 'DROPPED') AS dropouts FROM named GROUP BY ALL),
  moved AS (SELECT year_label AS academic_year, semester_label AS semester, college_name AS college, program_name AS program, gender, count(*) AS shifters
    FROM enr s JOIN program p ON s.from_program_id = p.program_id JOIN college c ON p.college_id = c.college_id JOIN period USING (period_ordinal) WHERE s.from_program_id <> s.program_id GROUP BY ALL)
  SELECT b.*, CAST(NULL AS INTEGER) AS applicants, CAST(NULL AS INTEGER) AS accepted, coalesce(graduates, 0) AS graduates, coalesce(dropouts, 0) AS dropouts, coalesce(shifters, 0) AS shifters
  FROM base b LEFT JOIN ended USING (academic_year, semester, college, program, gender) LEFT JOIN moved USING (academic_year, semester, college, program, gender)""")
def mart_canonical(spark: SparkSession, sf: str) -> DataFrame:
    enrolled = R.enrollment(spark, sf)
    made = marts.canonical(enrolled, R.shifts(enrolled), R.colleges(spark, sf), R.programs(spark, sf), _period(spark))
    return marts.chronological(made, "academic_year", "semester")


# --- features and forecasts ---


def _feature_sql(metric: str, series: str) -> str:
    w = f"PARTITION BY {series} ORDER BY period_ordinal"
    before = f"({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""{metric}, lag({metric}, 1) OVER ({w}) AS {metric}_lag_1, lag({metric}, 2) OVER ({w}) AS {metric}_lag_2,
      round(avg({metric}) OVER ({w} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 6) AS {metric}_rolling_avg_2, round(avg({metric}) OVER {before}, 6) AS {metric}_historical_avg,
      round(CASE WHEN isnan(regr_slope({metric}, period_ordinal) OVER {before}) THEN NULL ELSE regr_slope({metric}, period_ordinal) OVER {before} END, 6) AS {metric}_trend,
      round(avg({metric}) OVER (PARTITION BY {series}, semester_number ORDER BY period_ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS {metric}_seasonality,
      round(CAST(lag({metric}, 1) OVER ({w}) - lag({metric}, 2) OVER ({w}) AS DOUBLE) / nullif(lag({metric}, 2) OVER ({w}), 0), 6) AS {metric}_growth"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _program_counts(spark: SparkSession, sf: str) -> DataFrame:
    enrolled = R.enrollment(spark, sf)
    key = ["college_id", "program_id", "period_ordinal", "semester_number"]
    return feat.aligned_counts(enrolled, enrolled.where("enrollment_status = 'GRADUATED'"), key, ("enrollment_count", "graduation_count"))


_COUNTS = f"""WITH {R.SQL}, a AS (SELECT college_id, program_id, period_ordinal, semester_number, count(*) AS enrollment_count FROM enr GROUP BY ALL),
  g AS (SELECT college_id, program_id, period_ordinal, semester_number, count(*) AS graduation_count FROM enr WHERE enrollment_status = 'GRADUATED' GROUP BY ALL),
  counts AS (SELECT college_id, program_id, period_ordinal, semester_number, coalesce(enrollment_count, 0) AS enrollment_count, coalesce(graduation_count, 0) AS graduation_count
    FROM a FULL JOIN g USING (college_id, program_id, period_ordinal, semester_number))"""


@query(f"{_COUNTS} SELECT college_id, program_id, period_ordinal, semester_number, {_feature_sql('enrollment_count', 'college_id, program_id')}, {_feature_sql('graduation_count', 'college_id, program_id')} FROM counts")
def program_features(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(feat.features(_program_counts(spark, sf), ["college_id", "program_id"], "period_ordinal", "semester_number", ["enrollment_count", "graduation_count"]))


@query(f"""WITH {R.SQL}, c AS (SELECT college_id, program_id, year_level, period_ordinal, semester_number, count(*) AS enrollment_count FROM enr GROUP BY ALL)
  SELECT college_id, program_id, year_level, period_ordinal, semester_number, {_feature_sql('enrollment_count', 'college_id, program_id, year_level')} FROM c""")
def features_by_level(spark: SparkSession, sf: str) -> DataFrame:
    key = ["college_id", "program_id", "year_level"]
    counted = R.enrollment(spark, sf).groupBy(*key, "period_ordinal", "semester_number").agg(F.count("*").alias("enrollment_count"))
    return _rounded(feat.features(counted, key, "period_ordinal", "semester_number", ["enrollment_count"]))


@query()
def dataset_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return checks.fingerprint(program_features(spark, sf))


_FOLDS = f"""{_COUNTS}, points AS (SELECT max(period_ordinal) - i AS t FROM counts, range(3) r(i) GROUP BY i),
  folds AS (SELECT program_id, CAST(t AS INTEGER) AS test_ordinal, CAST(max(CASE WHEN period_ordinal = t THEN enrollment_count END) AS DOUBLE) AS actual,
    CAST(arg_max(enrollment_count, period_ordinal) FILTER (period_ordinal < t) AS DOUBLE) AS naive, avg(enrollment_count) FILTER (period_ordinal < t) AS historical_avg,
    CAST(max(CASE WHEN period_ordinal = t - 2 THEN enrollment_count END) AS DOUBLE) AS seasonal_naive
    FROM counts JOIN points ON period_ordinal <= t GROUP BY ALL HAVING actual IS NOT NULL AND naive IS NOT NULL)"""


def _folds(spark: SparkSession, sf: str) -> DataFrame:
    return fc.baselines(_program_counts(spark, sf), ["program_id"], "period_ordinal", "enrollment_count")


@query(f"{_FOLDS} SELECT program_id, test_ordinal, actual, naive, round(historical_avg, 6) AS historical_avg, seasonal_naive FROM folds")
def baseline_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_folds(spark, sf))


def _error_sql(m: str) -> str:
    return f"""round(avg(abs(actual - {m})), 6) AS {m}_mae, round(sqrt(avg((actual - {m}) ** 2)), 6) AS {m}_rmse,
      round(avg(CASE WHEN actual <> 0 THEN abs((actual - {m}) / nullif(actual, 0)) END) * 100, 6) AS {m}_mape,
      round(CASE WHEN max(CASE WHEN {m} IS NOT NULL THEN actual END) = min(CASE WHEN {m} IS NOT NULL THEN actual END) THEN CASE WHEN sum((actual - {m}) ** 2) = 0 THEN 1.0 ELSE 0.0 END
        ELSE 1 - sum((actual - {m}) ** 2) / nullif(sum(CASE WHEN {m} IS NOT NULL THEN actual * actual END) - count({m}) * avg(CASE WHEN {m} IS NOT NULL THEN actual END) ** 2, 0) END, 6) AS {m}_r2"""


@query(f"{_FOLDS} SELECT program_id, {', '.join(_error_sql(m) for m in ('naive', 'historical_avg', 'seasonal_naive'))} FROM folds GROUP BY 1")
def walkforward_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(fc.evaluate(_folds(spark, sf), ["program_id"], ["naive", "historical_avg", "seasonal_naive"]))


@query(f"""{_FOLDS}, e AS (SELECT program_id, avg(abs(actual - naive)) AS naive_mae, avg(abs(actual - historical_avg)) AS historical_avg_mae, avg(abs(actual - seasonal_naive)) AS seasonal_naive_mae,
  avg(abs(actual - (naive + historical_avg) / 2)) AS candidate_mae FROM folds GROUP BY 1)
  SELECT program_id, round(candidate_mae, 6) AS candidate_mae, round(least(naive_mae, historical_avg_mae, seasonal_naive_mae), 6) AS best_baseline_mae,
    round(candidate_mae - least(naive_mae, historical_avg_mae, seasonal_naive_mae), 6) AS mae_diff, candidate_mae < least(naive_mae, historical_avg_mae, seasonal_naive_mae) AS beats_best_baseline FROM e""")
def best_baseline(spark: SparkSession, sf: str) -> DataFrame:
    folds = _folds(spark, sf).withColumn("candidate", (F.col("naive") + F.col("historical_avg")) / 2)
    made = fc.best_baseline(fc.evaluate(folds, ["program_id"], ["candidate", "naive", "historical_avg", "seasonal_naive"]))
    return _rounded(made.select("program_id", "candidate_mae", "best_baseline_mae", "mae_diff", "beats_best_baseline"))


@query()
def fitted_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Walk-forward errors of the fitted model beside the baselines."""
    series = fc.long_enough(_program_counts(spark, sf), ["program_id"], "period_ordinal")
    key = ["program_id", "test_ordinal"]
    folds = fc.baselines(series, ["program_id"], "period_ordinal", "enrollment_count").join(fc.fitted_folds(series, ["program_id"], "period_ordinal", "enrollment_count", R.LAST), key, "left")
    return fc.best_baseline(fc.evaluate(folds, ["program_id"], ["candidate", "naive", "historical_avg", "seasonal_naive"]))


@query()
def forecast_fit(spark: SparkSession, sf: str) -> DataFrame:
    return fc.forecast_next(_program_counts(spark, sf), ["program_id"], "period_ordinal", "enrollment_count")


@query(f"""{_COUNTS}, p AS (SELECT *, enrollment_count < 0 AS neg, count(*) OVER (PARTITION BY program_id, period_ordinal) > 1 AS rep FROM counts)
  SELECT * FROM (SELECT 'null_ordinal' AS problem, count(*) FILTER (period_ordinal IS NULL) AS rows FROM p UNION ALL SELECT 'repeated_ordinal', count(*) FILTER (rep) FROM p
  UNION ALL SELECT 'null_value', count(*) FILTER (enrollment_count IS NULL) FROM p UNION ALL SELECT 'negative_value', count(*) FILTER (neg) FROM p)""")
def series_contract(spark: SparkSession, sf: str) -> DataFrame:
    return fc.series_problems(_program_counts(spark, sf), ["program_id"], "period_ordinal", "enrollment_count")


# --- registry ---


def _registry(spark: SparkSession, sf: str) -> DataFrame:
    """Three versions of a model for each program."""
    version = F.explode(F.sequence(F.lit(1), F.lit(3))).alias("version")
    made = R.programs(spark, sf).select("program_id", "program_key", version)
    return made.select(
        "program_id", P.model_version(F.col("program_id"), F.lit("enrollment"), F.expr("make_timestamp_ntz(2001, version, 1, 0, 0, 0)")).alias("model_version"),
        F.expr("make_timestamp_ntz(2001, version, 1, 0, 0, 0)").alias("trained_at"), (F.pmod(F.col("program_key") * 7 + F.col("version"), F.lit(10)) + 0.5).cast("double").alias("mae"),
        (F.col("version") == 2).alias("is_champion"), (9 + F.col("version")).cast("int").alias("trained_to"),
    )


_REGISTRY = f"""WITH {R.SQL}, registry AS (SELECT program_id, program_id || '_enrollment_20010' || v || '01T000000Z' AS model_version, make_timestamp(2001, v, 1, 0, 0, 0) AS trained_at,
  CAST((program_key * 7 + v) % 10 + 0.5 AS DOUBLE) AS mae, v = 2 AS is_champion, CAST(9 + v AS INTEGER) AS trained_to FROM program, range(1, 4) r(v))"""


@query(f"""{_REGISTRY} SELECT program_id, model_version, mae FROM (SELECT *, row_number() OVER (PARTITION BY program_id ORDER BY trained_at DESC, model_version DESC) AS r FROM registry WHERE is_champion) WHERE r = 1""")
def champion_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return fc.champions(_registry(spark, sf), ["program_id"]).select("program_id", "model_version", "mae")


@query(f"""{_REGISTRY}, cur AS (SELECT program_id, max(period_ordinal) - program_key % 4 AS current_max FROM program LEFT JOIN enr USING (program_id) GROUP BY program_id, program_key),
  l AS (SELECT program_id, arg_max(trained_to, trained_at) AS last_trained FROM registry WHERE program_id NOT LIKE '%-5' GROUP BY 1)
  SELECT program_id, CAST(current_max AS INTEGER) AS current_max, last_trained, CASE WHEN last_trained IS NULL THEN 'bootstrap' WHEN current_max > last_trained THEN 'new_period'
  WHEN current_max < last_trained THEN 'regressed' ELSE 'unchanged' END AS reason, last_trained IS NULL OR coalesce(current_max > last_trained, false) AS retrain FROM cur LEFT JOIN l USING (program_id)""")
def retrain_gate(spark: SparkSession, sf: str) -> DataFrame:
    keyed = R.programs(spark, sf).select("program_id", "program_key").join(R.enrollment(spark, sf).select("program_id", "period_ordinal"), "program_id", "left")
    now = keyed.groupBy("program_id", "program_key").agg(F.max("period_ordinal").alias("m")).select("program_id", (F.col("m") - F.col("program_key") % 4).cast("int").alias("current_max"))
    last = fc.newest(_registry(spark, sf).where("program_id NOT LIKE '%-5'"), ["program_id"]).select("program_id", F.col("trained_to").alias("last_trained"))
    return fc.retrain_gate(now, last, ["program_id"])


@query(f"""{_REGISTRY}, c AS (SELECT program_id, CAST(program_key % 8 AS DOUBLE) AS mae, CAST(4.5 AS DOUBLE) AS best_baseline_mae FROM program), ch AS (SELECT program_id, mae AS champion_mae FROM registry WHERE is_champion AND program_id NOT LIKE '%-1'),
  d AS (SELECT *, CASE WHEN NOT mae < best_baseline_mae THEN 'baseline' WHEN mae > champion_mae THEN 'champion' WHEN champion_mae IS NULL THEN 'bootstrap' ELSE 'improves' END AS reason FROM c LEFT JOIN ch USING (program_id))
  SELECT *, reason IN ('bootstrap', 'improves') AS promote FROM d""")
def promotion_decision(spark: SparkSession, sf: str) -> DataFrame:
    candidates = R.programs(spark, sf).select("program_id", (F.col("program_key") % 8).cast("double").alias("mae"), F.lit(4.5).alias("best_baseline_mae"))
    champions = fc.champions(_registry(spark, sf), ["program_id"]).where("program_id NOT LIKE '%-1'")
    return fc.promotion(candidates, champions, ["program_id"])


@query(f"""{_REGISTRY} SELECT program_id, model_version, mae, CASE WHEN program_id LIKE '%-2' THEN false ELSE is_champion END AS is_champion FROM registry
  UNION ALL SELECT program_id, program_id || '_new', CAST(0.25 AS DOUBLE), program_id LIKE '%-2' FROM program""")
def registry_record(spark: SparkSession, sf: str) -> DataFrame:
    registry = _registry(spark, sf).select("program_id", "model_version", "mae", "is_champion")
    fresh = R.programs(spark, sf).select("program_id", F.concat("program_id", F.lit("_new")).alias("model_version"), F.lit(0.25).alias("mae"), F.col("program_id").like("%-2").alias("is_champion"))
    return fc.record(registry, fresh, ["program_id"])


@query(f"""{_COUNTS}, o AS (SELECT program_id, period_ordinal, CAST(enrollment_count AS DOUBLE) AS yhat, CAST(1 AS INTEGER) AS run FROM counts),
  n AS (SELECT program_id, period_ordinal, CAST(graduation_count AS DOUBLE) AS yhat, CAST(2 AS INTEGER) AS run FROM counts WHERE period_ordinal % 3 = 0)
  SELECT * FROM n UNION ALL SELECT * FROM o WHERE period_ordinal % 3 <> 0""")
def forecast_upsert(spark: SparkSession, sf: str) -> DataFrame:
    counts = _program_counts(spark, sf)
    old = counts.select("program_id", "period_ordinal", F.col("enrollment_count").cast("double").alias("yhat"), F.lit(1).alias("run"))
    new = counts.where("period_ordinal % 3 = 0").select("program_id", "period_ordinal", F.col("graduation_count").cast("double").alias("yhat"), F.lit(2).alias("run"))
    return fc.upsert(old, new, ["program_id", "period_ordinal"], "run")


@query(f"""{_FOLDS} SELECT program_id, max(CASE WHEN test_ordinal = 11 THEN actual END) AS actual_11, max(CASE WHEN test_ordinal = 11 THEN naive END) AS forecast_11, max(CASE WHEN test_ordinal = 12 THEN actual END) AS actual_12,
  max(CASE WHEN test_ordinal = 12 THEN naive END) AS forecast_12, max(CASE WHEN test_ordinal = 13 THEN actual END) AS actual_13, max(CASE WHEN test_ordinal = 13 THEN naive END) AS forecast_13 FROM folds GROUP BY 1""")
def pivot_actual_forecast(spark: SparkSession, sf: str) -> DataFrame:
    wide = _folds(spark, sf).groupBy("program_id").pivot("test_ordinal", [11, 12, 13]).agg(F.max("actual").alias("actual"), F.max("naive").alias("forecast"))
    return wide.select("program_id", *[F.col(f"{t}_{c}").alias(f"{c}_{t}") for t in (11, 12, 13) for c in ("actual", "forecast")])


@query(f"{_COUNTS} SELECT program_id, period_ordinal, enrollment_count FROM (SELECT *, row_number() OVER (PARTITION BY program_id ORDER BY period_ordinal DESC) AS r FROM counts) WHERE r = 1")
def latest_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.latest_per_key(_program_counts(spark, sf), ["program_id"], [F.desc("period_ordinal")]).select("program_id", "period_ordinal", "enrollment_count")


@query(f"WITH {R.SQL} SELECT college_id, period_ordinal, success_rate FROM kpi WHERE college_id = 2 AND period_ordinal >= 0")
def dashboard_history(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.history(_kpi(spark, sf), "period_ordinal", college_id=2).select("college_id", "period_ordinal", "success_rate")


@query(f"WITH {R.SQL} SELECT college_id, success_rate FROM kpi WHERE period_ordinal = (SELECT max(period_ordinal) FROM kpi)")
def dashboard_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.ranking(_kpi(spark, sf), "period_ordinal", "success_rate", "college_id").select("college_id", "success_rate")


@query(f"""{_REGISTRY} SELECT p.program_id, r.model_version, CAST(program_key AS DOUBLE) AS yhat, trained_at, mae, is_champion, program_name FROM program p
  JOIN registry r ON p.program_id = r.program_id AND r.model_version LIKE '%200102%'""")
def dashboard_provenance(spark: SparkSession, sf: str) -> DataFrame:
    """Forecast, registry entry and program."""
    registry, programs = _registry(spark, sf), R.programs(spark, sf)
    forecasts = registry.where("model_version LIKE '%200102%'").join(programs, "program_id").select("program_id", "model_version", F.col("program_key").cast("double").alias("yhat"))
    made = dashboard.provenance(forecasts, registry, programs.select("program_id", "program_name"), ["program_id"])
    return made.select("program_id", "model_version", "yhat", "trained_at", "mae", "is_champion", "program_name")


@query(f"WITH {R.SQL} SELECT DISTINCT academic_year, semester_number FROM enr")
def dashboard_choices(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.choices(R.enrollment(spark, sf), "academic_year", "semester_number")


# --- constraints ---


@query("""SELECT 'matches:academic_year' AS check, CAST(0 AS BIGINT) AS violations UNION ALL SELECT 'accepted_values:semester', 0 UNION ALL SELECT 'accepted_values:year_level', 0
  UNION ALL SELECT 'not_null:' || c, 0 FROM (VALUES ('academic_year'), ('semester'), ('college'), ('program'), ('gender'), ('year_level')) v(c)
  UNION ALL SELECT 'in_range:' || c, 0 FROM (VALUES ('freshmen_count'), ('applicants'), ('accepted'), ('enrolled'), ('graduates'), ('dropouts'), ('shifters')) v(c)""")
def canonical_contract(spark: SparkSession, sf: str) -> DataFrame:
    """The canonical mart keeps its contract."""
    return marts.canonical_violations(mart_canonical(spark, sf))


@query("""SELECT 'college_id_unique' AS check, 'OK' AS status, CAST(0 AS BIGINT) AS found UNION ALL SELECT 'program_id_unique', 'OK', 0
  UNION ALL SELECT 'program_college', CASE WHEN count(*) = 0 THEN 'OK' ELSE 'ATTENTION' END, count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey < 4)""")
def reference_integrity(spark: SparkSession, sf: str) -> DataFrame:
    colleges = R.read(spark, sf, "region").where("r_regionkey < 4").select(F.col("r_regionkey").alias("college_id"))
    programs = R.read(spark, sf, "nation").select(F.col("n_nationkey").alias("program_id"), F.col("n_regionkey").alias("college_id"))
    return reports.reference_integrity(colleges, programs)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def constraint_unique(spark: SparkSession, sf: str) -> DataFrame:
    return checks.not_unique(R.read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, l_suppkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_nationkey < 20)")
def constraint_relationships(spark: SparkSession, sf: str) -> DataFrame:
    return checks.orphans(R.read(spark, sf, "lineitem").select("l_orderkey", "l_suppkey"), R.read(spark, sf, "supplier").where("s_nationkey < 20"), "l_suppkey", "s_suppkey")


@query("""SELECT 'not_null:o_orderpriority' AS check, count(*) FILTER (o_orderpriority IS NULL) AS violations FROM orders
  UNION ALL SELECT 'accepted_values:o_orderstatus', count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) FROM orders
  UNION ALL SELECT 'in_range:o_totalprice', count(*) FILTER (o_totalprice < 1000 OR o_totalprice > 300000) FROM orders
  UNION ALL SELECT 'matches:o_orderpriority', count(*) FILTER (NOT regexp_matches(o_orderpriority, '^[1-3]-')) FROM orders""")
def constraint_row_checks(spark: SparkSession, sf: str) -> DataFrame:
    wanted = [checks.not_null("o_orderpriority"), checks.accepted_values("o_orderstatus", ["F", "O"]), checks.in_range("o_totalprice", 1000, 300000), checks.matches("o_orderpriority", "^[1-3]-")]
    return checks.violations(R.read(spark, sf, "orders"), wanted)


@query(f"WITH {R.SQL} SELECT college_id, period_ordinal, success_rate FROM kpi WHERE success_rate < 0 OR success_rate > 45")
def constraint_range(spark: SparkSession, sf: str) -> DataFrame:
    return _kpi(spark, sf).where(checks.in_range("success_rate", 0, 45).broken).select("college_id", "period_ordinal", "success_rate")


@query(f"""WITH {R.SQL} SELECT period_label, count(e.student_id) AS n, count(e.student_id) > 0 AS is_covered FROM period p LEFT JOIN (SELECT * FROM enr WHERE period_ordinal <> 4) e USING (period_ordinal) GROUP BY 1""")
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Whether every expected period has rows."""
    seen = R.enrollment(spark, sf).where("period_ordinal <> 4").groupBy("period_ordinal").agg(F.count("*").alias("n"))
    met = _period(spark).join(seen, "period_ordinal", "left")
    return met.select("period_label", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("is_covered"))


@query(f"""WITH {R.SQL} SELECT student_id, period_ordinal, year_level, CASE WHEN year_level <= 1 THEN 'Freshman' WHEN year_level = 2 THEN 'Sophomore' WHEN year_level = 3 THEN 'Junior' WHEN year_level = 4 THEN 'Senior'
  WHEN year_level > ceil(nominal_duration_years) THEN 'Super Senior' ELSE 'Senior' END AS label, CAST(least(6, greatest(1, academic_year - 1996)) AS INTEGER) AS by_cohort FROM enr JOIN program USING (program_id)""")
def year_level_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.enrollment(spark, sf).join(R.programs(spark, sf).select("program_id", "nominal_duration_years"), "program_id")
    return rows.select("student_id", "period_ordinal", "year_level", P.year_level_label(F.col("year_level"), F.col("nominal_duration_years")).alias("label"), P.level_of_cohort(F.col("academic_year"), F.lit(1997)).alias("by_cohort"))


# --- landing ---


@query(f"""WITH {R.SQL} SELECT 'enrollment' AS entity, year_label AS partition_key, CASE WHEN academic_year % 3 = 0 THEN 'NEW' WHEN academic_year % 2 = 0 THEN 'DRIFT' ELSE 'DONE' END AS state
  FROM period WHERE semester_number = 1""")
def ingest_unit_states(spark: SparkSession, sf: str) -> DataFrame:
    """Which units an ingestion would land: not logged, logged but lost, or neither."""
    units = _period(spark).where("semester_number = 1").select(F.lit("enrollment").alias("entity"), F.col("year_label").alias("partition_key"), "academic_year")
    logged = units.where("academic_year % 3 <> 0")
    return bronze.unit_states(units.drop("academic_year"), logged, logged.where("academic_year % 2 <> 0"))


@query("""WITH b AS (SELECT CAST(i % 7 AS VARCHAR) AS partition_key, 'b' || i AS batch_id, i FROM range(20) t(i))
  SELECT 'enrollment' AS entity, partition_key, batch_id, CASE WHEN i % 5 = 0 THEN 'MISSING_OBJECT' WHEN i % 3 = 0 THEN 'EMPTY_OBJECT' ELSE 'OK' END AS audit_status FROM b""")
def bronze_audit(spark: SparkSession, sf: str) -> DataFrame:
    ids = spark.range(20)
    logged = ids.select(F.lit("enrollment").alias("entity"), F.pmod("id", F.lit(7)).cast("string").alias("partition_key"), F.concat(F.lit("b"), "id").alias("batch_id"), "id")
    stored = logged.where("id % 5 <> 0").withColumn("length", F.when(F.col("id") % 3 == 0, 0).otherwise(100))
    return bronze.audit(logged.drop("id"), stored.drop("id"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def ingest_idempotent_twice(spark: SparkSession, sf: str) -> DataFrame:
    """What is landed after two runs over the same source is what one run lands."""
    root = files.scratch(spark)
    log = bronze.RunLog(spark, f"{root}/log")
    columns = ["o_orderkey", "o_custkey", "o_orderstatus"]
    orders = R.read(spark, sf, "orders").select(*columns)
    for _ in range(2):
        for status in ("F", "O", "P"):
            bronze.ingest(log, root, "orders", status, lambda s=status: orders.where(F.col("o_orderstatus") == s), columns)
    return files.read_all_partitions(spark, f"{root}/orders").select(*columns)


@query()
def synthetic_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    entered = synthetic.students(spark, P.Calendar(2021, 2026), 1000, 37)
    return synthetic.outcomes(synthetic.progression(entered, P.Calendar(2021, 2026), 37), entered)


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming window of ``medlar.streaming.landing`` over a table at rest."""
    counted = R.read(spark, sf, "events").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), "event_type", "n")


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """As-of facts, the composite indicator and its enrollment-weighted summary."""
    return marts.executive_summary(_kpi(spark, sf), ["period_ordinal"])



