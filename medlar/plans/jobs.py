"""Queries that run whole jobs over the test tables: scans, sinks, landing, publishing, contracts and deployment. What they
write lies in a scratch folder of their own, and what they return is read back from there."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medlar.functions import normalize as N
from medlar.functions import periods as P
from medlar.operators import checks, dims, rules
from medlar.plans import deploy, reports, run, silver
from medlar.plans import forecasting as fc
from medlar.plans import queries as Q
from medlar.plans import registrar as R
from medlar.plans.queries import query
from medlar.sources import bronze, files, synthetic


def _lines(spark: SparkSession, rows: list[tuple], schema: str = "item string, n long") -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _fails(job, kind: type[BaseException]) -> bool:
    try:
        job()
    except kind:
        return True
    return False


# --- scans ---


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A CSV file with an untidy header, as text under tidy names; a file that isn't there is no error."""
    root = files.scratch(spark)
    nation = R.read(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    nation.toDF(" N_NationKey", "N_Name ", "n_regionkey").coalesce(1).write.option("header", True).csv(f"{root}/nation")
    if files.read_csv(spark, f"{root}/missing") is not None:
        raise ValueError("a missing file was read")
    return files.read_csv(spark, f"{root}/nation")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def csv_tree_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Partitioned CSV, read back as all files of a kind anywhere below its root."""
    root = files.scratch(spark)
    files.write_partitioned_csv(R.read(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), f"{root}/by_region", ["n_regionkey"])
    return files.read_csv_tree(spark, root, "*.csv", ["n_nationkey", "n_name"])


@query("SELECT CAST(r_regionkey AS INTEGER) AS key, r_name AS name FROM region")
def reference_document_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a list in a reference document; an entry with an unknown key is an error."""
    entries = [{"key": r["r_regionkey"], "name": r["r_name"]} for r in R.read(spark, sf, "region").collect()]
    if not _fails(lambda: files.reference_rows(spark, json.dumps({"regions": [{"key": 1, "odd": 2}]}), "regions", ["key", "name"], "key int, name string"), ValueError):
        raise ValueError("an unknown key was read")
    return files.reference_rows(spark, json.dumps({"regions": entries}), "regions", ["key", "name"], "key int, name string")


_STATEMENT = "SELECT n_name, count(*) AS customers, CAST(sum(c_acctbal) AS DOUBLE) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"


@query(f"SELECT n_name, customers, round(balance, 2) AS balance FROM ({_STATEMENT})")
def sql_table_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A statement over tables registered for it."""
    found = files.sql_scan(spark, _STATEMENT, customer=R.read(spark, sf, "customer"), nation=R.read(spark, sf, "nation"))
    if spark.catalog.tableExists("customer"):
        raise ValueError("a registration was left behind")
    return found.withColumn("balance", F.round("balance", 2))


@query("SELECT o_orderstatus AS part, CAST(1 AS BIGINT) AS files, true AS has_length FROM orders GROUP BY 1")
def file_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Names and lengths of stored files, without their content."""
    root = files.scratch(spark)
    R.read(spark, sf, "orders").select("o_orderkey", "o_orderstatus").repartition(1).write.partitionBy("o_orderstatus").parquet(root)
    found = files.listing(spark, root, "*.parquet").withColumn("part", F.regexp_extract("path", "o_orderstatus=([^/]+)", 1))
    return found.groupBy("part").agg(F.count("*").alias("files"), F.min(F.col("length") > 0).alias("has_length"))


@query("SELECT r_name AS name, sha256(r_name || chr(10)) AS sha256 FROM region")
def file_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """SHA-256 of small files, one for each region."""
    root = files.scratch(spark)
    region = R.read(spark, sf, "region").select("r_name", F.col("r_name").alias("value"))
    region.repartition(1).write.partitionBy("r_name").text(root)
    found = files.fingerprints(spark, root, "*.txt")
    return found.select(F.url_decode(F.regexp_replace(F.regexp_extract("path", "r_name=([^/]+)", 1), "%25", "%")).alias("name"), "sha256")


# --- sinks ---


@query("SELECT 'missing table is an error' AS item, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'rows', (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0) UNION ALL SELECT 'sum', (SELECT sum(o_orderkey * 2)::BIGINT FROM orders WHERE o_orderkey % 3 = 0)")
def replace_table(spark: SparkSession, sf: str) -> DataFrame:
    """A table is replaced as a whole by what was read from it; one that isn't there can't be."""
    path = f"{files.scratch(spark)}/orders"
    orders = R.read(spark, sf, "orders").select("o_orderkey")
    missing = _fails(lambda: files.replace(orders, path, must_exist=True), FileNotFoundError)
    files.replace(orders, path)
    files.replace(spark.read.parquet(path).where("o_orderkey % 3 = 0").selectExpr("o_orderkey * 2 AS o_orderkey"), path, must_exist=True)
    got = spark.read.parquet(path)
    sums = got.agg(F.count("*").alias("rows"), F.sum("o_orderkey").alias("sum"))
    return _lines(spark, [("missing table is an error", int(missing))]).union(sums.select(F.expr("stack(2, 'rows', rows, 'sum', sum) AS (item, n)")))


@query("SELECT o_orderkey, 'known_status' AS failed_rule FROM orders WHERE o_orderstatus = 'P'")
def quarantine_output(spark: SparkSession, sf: str) -> DataFrame:
    """Rejected rows are written beside the valid ones; without any nothing is written."""
    root = files.scratch(spark)
    tagged = rules.tag(R.read(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), [rules.Rule("known_status", F.col("o_orderstatus").isin("F", "O"))])
    valid, rejected = rules.split(tagged)
    files.write_quarantine(rejected, f"{root}/orders")
    if files.write_quarantine(valid.limit(0), f"{root}/none") or files.exists(spark, f"{root}/none"):
        raise ValueError("an empty quarantine was written")
    return spark.read.parquet(f"{root}/orders").select("o_orderkey", "failed_rule")


@query("""SELECT 'version' AS item, CAST(2 AS BIGINT) AS n UNION ALL SELECT 'broken set stays out', 1 UNION ALL SELECT 'hidden columns', 0
  UNION ALL SELECT 'nation', (SELECT count(*) FROM nation) UNION ALL SELECT 'customer', (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0)""")
def publish_versions(spark: SparkSession, sf: str) -> DataFrame:
    """A connected set of tables is seen as one version, and only one that keeps its references."""
    root = files.scratch(spark)
    nation, customer = R.read(spark, sf, "nation"), R.read(spark, sf, "customer").select("c_custkey", "c_nationkey").withColumn("_batch_id", F.lit("b"))
    keeps = {"references": lambda x: checks.orphans(x["customer"], x["nation"], "c_nationkey", "n_nationkey"), "unique": lambda x: checks.not_unique(x["customer"], ["c_custkey"])}
    files.publish(spark, root, {"nation": nation, "customer": customer}, "1", keeps)
    files.publish(spark, root, {"nation": nation, "customer": customer.where("c_custkey % 2 = 0")}, "2", keeps)
    broken = _fails(lambda: files.publish(spark, root, {"nation": nation.where("n_nationkey > 3"), "customer": customer}, "3", keeps), files.ConstraintError)
    seen = files.current(spark, root, "customer")
    counts = seen.agg(F.count("*").alias("c")).crossJoin(files.current(spark, root, "nation").agg(F.count("*").alias("n")))
    lines = [("version", int(files.current_version(spark, root))), ("broken set stays out", int(broken)), ("hidden columns", sum(c.startswith("_") for c in seen.columns))]
    return _lines(spark, lines).union(counts.select(F.expr("stack(2, 'nation', n, 'customer', c) AS (item, n)")))


@query("""SELECT 'college' AS item, 4 AS n UNION ALL SELECT 'program', 12 UNION ALL SELECT 'student', 120 UNION ALL SELECT 'current spells', 120 UNION ALL SELECT 'tables', 16
  UNION ALL SELECT 'unexplained rows', 0 UNION ALL SELECT 'facts with unknown keys', 0 UNION ALL SELECT 'retained is 0 or 1', 0""")
def run_whole_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """The whole way over a synthetic source: every landed enrollment is a fact, quarantined, rejected or a repeat."""
    root, calendar = files.scratch(spark), P.Calendar(2021, 2024)
    extracts = run.source(spark, calendar, 30)
    run.land(spark, root, extracts)
    result = run.build(spark, root, calendar)
    run.publish(spark, root, result, "1")
    of = lambda name: files.current(spark, f"{root}/gold", name)
    units = files.read_all_partitions(spark, f"{root}/bronze/enrollment").select("student_id", "academic_year", "semester_number").distinct().count()
    fact, student = of("fact_enrollment"), of("dim_student")
    unexplained = units - fact.count() - result.quarantine.count() - result.rejected["enrollment"].count()
    unknown = sum(checks.orphans(of(f), of(d), k, k).count() for f in ("fact_enrollment", "fact_graduation", "fact_dropout") for d, k in (("dim_program", "program_key"), ("dim_student", "student_key")))
    rows = [
        ("college", of("dim_college").count()), ("program", of("dim_program").count()), ("student", student.select("student_id").distinct().count()), ("current spells", student.where("is_current").count()),
        ("tables", len(result.gold) + 3), ("unexplained rows", unexplained), ("facts with unknown keys", unknown), ("retained is 0 or 1", of("fact_retention").where("NOT CAST(is_retained AS INT) IN (0, 1)").count()),
    ]
    return _lines(spark, rows, "item string, n int")


_ERRORS = f"{Q._FOLDS} SELECT program_id, round(avg(abs(actual - naive)), 2) AS naive_mae, round(avg(abs(actual - seasonal_naive)), 2) AS seasonal_naive_mae FROM folds GROUP BY 1"


@query(f"SELECT program_id, coalesce(CAST(naive_mae AS VARCHAR), 'n/a') AS naive_mae, coalesce(CAST(seasonal_naive_mae AS VARCHAR), 'n/a') AS seasonal_naive_mae FROM ({_ERRORS})")
def evaluation_report_files(spark: SparkSession, sf: str) -> DataFrame:
    """An evaluation as one CSV file and as a Markdown table with a line for each series."""
    path = f"{files.scratch(spark)}/report"
    made = fc.evaluate(Q._folds(spark, sf), ["program_id"], ["naive", "seasonal_naive"])
    made = made.select("program_id", *[F.round(c, 2).alias(c) for c in ("naive_mae", "seasonal_naive_mae")])
    files.write_csv_report(made, path)
    read = files.read_csv(spark, path)
    if len(files.markdown(made).splitlines()) != read.count() + 2:
        raise ValueError("the two reports differ")
    return read


@query("SELECT 'nation' AS name, count(*) AS rows, coalesce(sum(('0x' || substr(md5(n_name || '|' || n_nationkey), 1, 8))::BIGINT), 0)::BIGINT AS sum FROM nation UNION ALL SELECT 'region', count(*), sum(('0x' || substr(md5(r_name), 1, 8))::BIGINT)::BIGINT FROM region")
def source_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest of extracts, with counts and fingerprints, as it is written and read."""
    extracts = {"nation": R.read(spark, sf, "nation").select("n_nationkey", "n_name"), "region": R.read(spark, sf, "region").select("r_name")}
    path = f"{files.scratch(spark)}/manifest"
    spark.createDataFrame([(run.manifest(extracts, 42),)], "value string").coalesce(1).write.text(path)
    read = json.loads(files.read_text(spark, path))
    if read["seed"] != 42:
        raise ValueError("the seed is lost")
    return _lines(spark, [(n, read["rows"][n], int(read["fingerprints"][n])) for n in extracts], "name string, rows long, sum long")


@query("SELECT count(*) AS rows, sum(('0x' || substr(md5(coalesce(CAST(o_custkey AS VARCHAR), '') || '|' || o_orderkey || '|' || o_orderstatus), 1, 8))::BIGINT)::BIGINT AS sum FROM orders")
def table_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return checks.portable_fingerprint(R.read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"))


# --- landing ---


@query("""SELECT 'n_name' AS item, count(*) AS n FROM nation UNION ALL SELECT 'n_regionkey', count(*) FROM nation UNION ALL SELECT 'stamped', count(*) FROM nation
  UNION ALL SELECT 'missing column is an error', 1 UNION ALL SELECT 'no rows is an error', 1""")
def landing_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Tidy names, required columns, rows and audit columns of what is about to land."""
    nation = R.read(spark, sf, "nation").select("n_name", "n_regionkey").toDF(" N_Name", "n_RegionKey ")
    tidy = nation.toDF(*N.header(nation.columns))
    seen = bronze.inspect(tidy)
    stamped = bronze.stamp(bronze.require(tidy, ["n_name", "n_regionkey"]), "nation.csv", "b1").where("_ingested_at IS NOT NULL AND _source_file = 'nation.csv' AND _batch_id = 'b1'").count()
    lines = [(c, seen["rows"]) for c in seen["columns"]] + [("stamped", stamped)]
    lines.append(("missing column is an error", int(_fails(lambda: bronze.require(tidy, ["odd"]), bronze.IngestionError))))
    lines.append(("no rows is an error", int(_fails(lambda: bronze.require(tidy.limit(0), ["n_name"]), bronze.IngestionError))))
    return _lines(spark, lines)


@query("SELECT year(o_orderdate)::VARCHAR AS partition_key, count(*) AS rows FROM orders GROUP BY 1")
def ingest_all_units(spark: SparkSession, sf: str) -> DataFrame:
    """One unit for each year; the log has a success with the rows of each, and what is stored is all of them."""
    root = files.scratch(spark)
    log = bronze.RunLog(spark, f"{root}/log")
    orders = R.read(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    for (year,) in orders.select("year").distinct().collect():
        bronze.ingest(log, root, "orders", str(year), lambda y=year: orders.where(F.col("year") == y), ["o_orderkey", "year"], source="orders")
    stored = files.read_all_partitions(spark, f"{root}/orders").groupBy(F.col("year").cast("string").alias("partition_key")).agg(F.count("*").alias("stored"))
    return log.read().where("status = 'SUCCESS'").join(stored, "partition_key").where("rows = stored").select("partition_key", "rows")


@query("""SELECT stage, entity, status, rows, category FROM (VALUES ('silver', 'orders', 'RUNNING', NULL::BIGINT, NULL), ('silver', 'orders', 'SUCCESS', (SELECT count(*) FROM orders), NULL),
  ('gold', 'missing', 'RUNNING', NULL, NULL), ('gold', 'missing', 'FAILED', NULL, 'ENGINE_ERROR'), ('gate', 'orders', 'RUNNING', NULL, NULL), ('gate', 'orders', 'FAILED', NULL, 'DUPLICATE_DATA'),
  ('store', 'orders', 'RUNNING', NULL, NULL), ('store', 'orders', 'FAILED', NULL, 'STORAGE_ERROR'), ('once', 'orders', 'SUCCESS', 1, NULL)) v(stage, entity, status, rows, category)""")
def run_log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the run log: stages that run, succeed and fail, by kind of failure; a success that is logged once."""
    log = bronze.RunLog(spark, f"{files.scratch(spark)}/log")
    log.tracked("silver", "orders", R.read(spark, sf, "orders").count)

    def repeats() -> int:
        raise bronze.PipelineError("too many repeats", "DUPLICATE_DATA")

    def gone() -> int:
        raise FileNotFoundError("orders")

    for stage, entity, job in (("gold", "missing", lambda: R.read(spark, sf, "missing").count()), ("gate", "orders", repeats), ("store", "orders", gone)):
        _fails(lambda s=stage, e=entity, j=job: log.tracked(s, e, j), Exception)
    if [log.append_once("once", "orders", "all", rows=1) for _ in range(2)] != [True, False]:
        raise ValueError("a success was logged twice")
    kind = F.when(F.col("status") == "FAILED", F.regexp_extract("message", "^([A-Z_]+):", 1))
    return log.read().orderBy("started_at").select("stage", "entity", "status", "rows", kind.alias("category"))


@query("SELECT year(o_orderdate)::VARCHAR AS partition_key, CASE year(o_orderdate) % 3 WHEN 0 THEN 'MISSING_OBJECT' ELSE 'OK' END AS audit_status FROM orders GROUP BY ALL")
def bronze_audit_of_landed(spark: SparkSession, sf: str) -> DataFrame:
    """The audit over files that were landed, and some of them lost."""
    root = files.scratch(spark)
    log = bronze.RunLog(spark, f"{root}/log")
    orders = R.read(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    years = [y for (y,) in orders.select("year").distinct().collect()]
    for year in years:
        bronze.ingest(log, f"{root}/bronze", "orders", str(year), lambda y=year: orders.where(F.col("year") == y), ["o_orderkey", "year"])
    for year in years:
        if year % 3 == 0:
            files.delete(spark, bronze.unit_path(f"{root}/bronze", "orders", str(year)))
    found = bronze.audit(log.succeeded().select("entity", "partition_key", "batch_id"), bronze.stored_batches(spark, f"{root}/bronze"))
    return found.select("partition_key", "audit_status")


# --- contracts ---

_DOCUMENT_ROWS = """SELECT CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN ' ' ELSE 'S' || (c_custkey // 2) END AS student_id,
  CAST(1994 + c_custkey % 9 AS INTEGER) AS cohort_academic_year, CASE WHEN c_custkey % 7 = 0 THEN 'X' WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
  CAST(1970 + c_custkey % 50 AS INTEGER) AS birth_year, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS home_province,
  CASE WHEN c_custkey % 3 = 0 THEN 'Freshman' ELSE 'Transferee' END AS admission_type, CAST(c_custkey % 4 AS INTEGER) AS entry_year_level, 'C1' AS entry_college_id, 'P' || c_nationkey AS entry_program_id FROM customer"""
_SPARK_ROWS = _DOCUMENT_ROWS.replace("(c_custkey // 2)", "(c_custkey div 2)").replace("FROM customer", "FROM c")


def _student_rows(spark: SparkSession, sf: str) -> DataFrame:
    return files.sql_scan(spark, _SPARK_ROWS, c=R.read(spark, sf, "customer"))


_NULLS = " UNION ALL ".join(f"SELECT 'not_null:{c}', count(*) FILTER ({c} IS NULL) FROM s" for c in silver.ENTITIES["student"] if c not in ("student_id", *silver.OPTIONAL))
_EMPTY = " UNION ALL ".join(f"SELECT 'not_empty:{c}', count(*) FILTER (trim({c}) = '') FROM s" for c, t in silver.ENTITIES["student"].items() if t == "string")


@query(f"""WITH s AS ({_DOCUMENT_ROWS}) SELECT 'not_null:student_id' AS check, count(*) FILTER (student_id IS NULL) AS violations FROM s UNION ALL {_NULLS} UNION ALL {_EMPTY}
  UNION ALL SELECT 'accepted_values:gender', count(*) FILTER (gender NOT IN ('Female', 'Male')) FROM s UNION ALL SELECT 'accepted_values:admission_type', 0
  UNION ALL SELECT 'in_range:cohort_academic_year', count(*) FILTER (cohort_academic_year NOT BETWEEN 1995 AND 2001) FROM s
  UNION ALL SELECT 'in_range:birth_year', count(*) FILTER (birth_year NOT BETWEEN 1980 AND 2010) FROM s UNION ALL SELECT 'in_range:entry_year_level', count(*) FILTER (entry_year_level < 1) FROM s
  UNION ALL SELECT 'unique:student_id', (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM s WHERE student_id IS NOT NULL GROUP BY student_id HAVING count(*) > 1))""")
def silver_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Every promise of a clean entity, counted where it is broken."""
    return silver.contract_report("student", _student_rows(spark, sf), R.CALENDAR)


_RAW_ENROLLMENT = """SELECT CAST(o_custkey AS VARCHAR) AS student_id, CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS academic_year,
  CAST(o_orderkey % 4 AS VARCHAR) AS semester_number, 'C' || (o_custkey % 5) AS college_id, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE 'P1' END AS program_id, o_orderstatus AS enrollment_status,
  CASE WHEN o_orderkey % 23 = 0 THEN 'first' ELSE CAST(o_orderkey % 6 AS VARCHAR) END AS year_level, CAST(o_orderkey % 10 - 2 AS VARCHAR) AS units_enrolled, 'true' AS is_new_enrollee FROM orders"""
_RAW_NULLS = " UNION ALL ".join(f"SELECT 'not_null:{c}' AS check, count(*) FILTER ({c} IS NULL) AS violations FROM e UNION ALL SELECT 'not_empty:{c}', count(*) FILTER (trim({c}) = '') FROM e" for c in silver.ENTITIES["enrollment"])


@query(f"""WITH e AS ({_RAW_ENROLLMENT}) {_RAW_NULLS} UNION ALL SELECT 'in_range:semester_number', count(*) FILTER (try_cast(semester_number AS DOUBLE) NOT BETWEEN 1 AND 2) FROM e
  UNION ALL SELECT 'in_range:year_level', count(*) FILTER (try_cast(year_level AS DOUBLE) < 1) FROM e UNION ALL SELECT 'in_range:units_enrolled', count(*) FILTER (try_cast(units_enrolled AS DOUBLE) < 0) FROM e""")
def bronze_contract(spark: SparkSession, sf: str) -> DataFrame:
    """The same for an entity as it arrives, all text."""
    rows = files.sql_scan(spark, _RAW_ENROLLMENT.replace("VARCHAR", "STRING").replace("FROM orders", "FROM o"), o=R.read(spark, sf, "orders"))
    return silver.contract_report("enrollment", rows, R.CALENDAR, landed=True)


@query(f"""WITH s AS ({_DOCUMENT_ROWS}), b AS (SELECT 'accepted_values:gender' AS check, student_id, birth_year FROM s WHERE gender NOT IN ('Female', 'Male')
  UNION ALL SELECT 'in_range:entry_year_level', student_id, birth_year FROM s WHERE entry_year_level < 1 UNION ALL SELECT 'in_range:birth_year', student_id, birth_year FROM s WHERE birth_year NOT BETWEEN 1980 AND 2010
  UNION ALL SELECT 'in_range:cohort_academic_year', student_id, birth_year FROM s WHERE cohort_academic_year NOT BETWEEN 1995 AND 2001 UNION ALL SELECT 'not_null:student_id', student_id, birth_year FROM s WHERE student_id IS NULL
  UNION ALL SELECT 'not_empty:student_id', student_id, birth_year FROM s WHERE trim(student_id) = '')
  SELECT "check", birth_year, student_id FROM (SELECT *, row_number() OVER (PARTITION BY "check" ORDER BY birth_year, student_id NULLS FIRST) AS r FROM b) WHERE r <= 5""")
def first_failures(spark: SparkSession, sf: str) -> DataFrame:
    """The first five rows that break each check."""
    return silver.first_failures("student", _student_rows(spark, sf), R.CALENDAR, ["birth_year", "student_id"])


@query(f"""WITH {R.SQL} SELECT 'college_columns' AS check, 'OK' AS status, CAST(0 AS BIGINT) AS found UNION ALL SELECT 'enrollment_columns', 'OK', 0 UNION ALL SELECT 'student_columns', 'ATTENTION', 5
  UNION ALL SELECT 'college_repeated_rows', 'OK', 0 UNION ALL SELECT 'student_repeated_rows', 'OK', 0 UNION ALL SELECT 'enrollment_repeated_rows', 'ATTENTION', (SELECT 2 * count(*) FROM enr WHERE student_id % 10 = 0)
  UNION ALL SELECT 'enrollment_orphans', 'ATTENTION', (SELECT count(*) FROM enr WHERE student_id % 7 = 0) UNION ALL SELECT 'uncovered_periods', 'ATTENTION', 2
  UNION ALL SELECT 'illegal_transitions', CASE WHEN count(*) = 0 THEN 'OK' ELSE 'ATTENTION' END, count(*) FROM (SELECT year_level - lag(year_level) OVER (PARTITION BY student_id ORDER BY period_ordinal) AS d FROM enr) WHERE d NOT IN (0, 1)""")
def pre_ingestion_report(spark: SparkSession, sf: str) -> DataFrame:
    """Columns, repeats, orphans, coverage and transitions of extracts before they land."""
    enrolled = R.enrollment(spark, sf).select(*silver.ENTITIES["enrollment"])
    enrolled = enrolled.union(enrolled.where("student_id % 10 = 0"))
    students = R.students(spark, sf).select("student_id", "gender", "admission_type", F.col("college_id").alias("entry_college_id")).where("student_id % 7 <> 0")
    colleges = R.colleges(spark, sf).select("college_id", "college_name")
    text = lambda df: df.select([F.col(c).cast("string").alias(c) for c in df.columns])
    return reports.pre_ingestion({"enrollment": text(enrolled), "student": text(students), "college": text(colleges)}, P.Calendar(1995, 2002))


@query(f"""WITH m AS (SELECT CASE WHEN i % 5 = 0 THEN '20-21' ELSE '2021-2022' END AS academic_year, CASE WHEN i % 7 = 0 THEN '3rd' ELSE '1st Semester' END AS semester,
  CASE WHEN i % 11 = 0 THEN NULL ELSE 'C' END AS college, 'P' AS program, 'Female' AS gender, CASE WHEN i % 3 = 0 THEN 'Ninth' ELSE 'Senior' END AS year_level, i - 3 AS freshmen_count, i AS applicants,
  -i AS accepted, 1 AS enrolled, 1 AS graduates, 1 AS dropouts, 1 AS shifters FROM (SELECT o_orderkey AS i FROM orders))
  SELECT 'matches:academic_year' AS check, count(*) FILTER (NOT regexp_matches(academic_year, '^[0-9]{{4}}-[0-9]{{4}}$')) AS violations FROM m
  UNION ALL SELECT 'accepted_values:semester', count(*) FILTER (semester NOT IN ('1st Semester', '2nd Semester')) FROM m UNION ALL SELECT 'accepted_values:year_level', count(*) FILTER (year_level = 'Ninth') FROM m
  UNION ALL {" UNION ALL ".join(f"SELECT 'not_null:{c}', count(*) FILTER ({c} IS NULL) FROM m" for c in ("academic_year", "semester", "college", "program", "gender", "year_level"))}
  UNION ALL {" UNION ALL ".join(f"SELECT 'in_range:{c}', count(*) FILTER ({c} < 0) FROM m" for c in ("freshmen_count", "applicants", "accepted", "enrolled", "graduates", "dropouts", "shifters"))}""")
def canonical_contract_broken(spark: SparkSession, sf: str) -> DataFrame:
    """The canonical mart's contract over rows that break it in many ways."""
    from medlar.plans import marts

    i = F.col("o_orderkey")
    rows = R.read(spark, sf, "orders").select(
        F.when(i % 5 == 0, "20-21").otherwise("2021-2022").alias("academic_year"), F.when(i % 7 == 0, "3rd").otherwise("1st Semester").alias("semester"), F.when(i % 11 != 0, "C").alias("college"), F.lit("P").alias("program"),
        F.lit("Female").alias("gender"), F.when(i % 3 == 0, "Ninth").otherwise("Senior").alias("year_level"), (i - 3).alias("freshmen_count"), i.alias("applicants"), (-i).alias("accepted"),
        *[F.lit(1).alias(c) for c in ("enrolled", "graduates", "dropouts", "shifters")],
    )
    return marts.canonical_violations(rows)


# --- columns ---


@query(f"WITH {R.SQL} SELECT period_ordinal, make_date(academic_year, CASE semester_number WHEN 1 THEN 1 ELSE 7 END, 1) AS period_start FROM period")
def period_dates(spark: SparkSession, sf: str) -> DataFrame:
    return Q._period(spark).select("period_ordinal", P.period_start(F.col("academic_year"), F.col("semester_number")).alias("period_start"))


@query("SELECT year, semester, other, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 3 <> 0 THEN year(o_orderdate)::VARCHAR END AS year, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 2 + 1)::VARCHAR END AS semester, NULL::VARCHAR AS other FROM orders) GROUP BY ALL")
def partition_key_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of keys such as academic_year=2021/semester=1; null where a part is missing."""
    i = F.col("o_orderkey")
    year = F.when(i % 3 != 0, F.concat(F.lit("academic_year="), F.year("o_orderdate").cast("string")))
    semester = F.when(i % 5 != 0, F.concat(F.lit("semester="), (i % 2 + 1).cast("string")))
    key = R.read(spark, sf, "orders").select(F.concat_ws("/", year, semester).alias("key"))
    parts = key.select(*[P.partition_part(F.col("key"), n).alias(a) for n, a in (("academic_year", "year"), ("semester", "semester"), ("year", "other"))])
    return parts.groupBy("year", "semester", "other").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, CASE WHEN x <= 1 THEN 0.1::DOUBLE WHEN x <= 50 THEN 0.1 + (x - 1) * ((0.4::DOUBLE - 0.1::DOUBLE) / (50.0::DOUBLE - 1.0::DOUBLE)) WHEN x <= 200 THEN 0.4 + (x - 50) * ((0.9::DOUBLE - 0.4::DOUBLE) / (200.0::DOUBLE - 50.0::DOUBLE)) ELSE 0.9 END AS chance
  FROM (SELECT o_orderkey, o_totalprice::DOUBLE / 1000 AS x FROM orders)""")
def interpolated_chance(spark: SparkSession, sf: str) -> DataFrame:
    """A broken line between points, flat outside."""
    x = F.col("o_totalprice").cast("double") / 1000
    return R.read(spark, sf, "orders").select("o_orderkey", P.interpolate(x, [(1.0, 0.1), (50.0, 0.4), (200.0, 0.9)]).alias("chance"))


@query("""SELECT c_custkey, substr(c_name, 1, a - 1) || substr(c_name, a + 1, 1) || substr(c_name, a, 1) || substr(c_name, a + 2) AS swapped, substr(c_name, 1, a - 1) || substr(c_name, a + 1) AS dropped
  FROM (SELECT c_custkey, c_name, CAST(c_custkey % 10 + 1 AS INTEGER) AS a FROM customer)""")
def spelling_noise(spark: SparkSession, sf: str) -> DataFrame:
    """The two typos of the noise: neighbours swapped, one letter dropped."""
    at = (F.col("c_custkey") % 10 + 1).cast("int")
    return R.read(spark, sf, "customer").select("c_custkey", synthetic.swapped(F.col("c_name"), at).alias("swapped"), synthetic.without_one(F.col("c_name"), at).alias("dropped"))


@query("""SELECT n_nationkey, freshmen, accepted, CAST(ceil(accepted / (0.4::DOUBLE + n_nationkey % 4 / 10.0::DOUBLE)) AS BIGINT) AS applicants FROM (SELECT n_nationkey, count(*) AS freshmen, CAST(ceil(count(*) / (0.5::DOUBLE + n_nationkey % 5 / 10.0::DOUBLE)) AS BIGINT) AS accepted
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey)""")
def admissions_funnel(spark: SparkSession, sf: str) -> DataFrame:
    """How many it took, at given shares, for the freshmen that there are."""
    counted = R.read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("freshmen"))
    key = F.col("n_nationkey")
    return synthetic.funnel_before(counted, "freshmen", F.lit(0.5) + key % 5 / F.lit(10.0), F.lit(0.4) + key % 4 / F.lit(10.0))


# --- the synthetic source ---


@query("SELECT CAST(2021 + i AS INTEGER) AS cohort_year, CAST(1000 AS BIGINT) AS students, true AS balanced FROM range(6) t(i)")
def synthetic_outcomes_balance(spark: SparkSession, sf: str) -> DataFrame:
    """Every student of every cohort is active, graduated or dropped, and in one of these only."""
    return Q.synthetic_outcomes(spark, sf).select("cohort_year", "students", "balanced")


@query(f"WITH {R.SQL} SELECT 'rows kept' AS item, count(*) AS n FROM enr UNION ALL SELECT 'late rows that lost their period', 0 UNION ALL SELECT 'copies that differ', 0 UNION ALL SELECT 'spellings out of hand', 0")
def noise_slices(spark: SparkSession, sf: str) -> DataFrame:
    """Noise adds rows and spellings and loses nothing: every row is there, late rows keep their period and land in the next
    one, copies are exact, and about one status in twenty-five is spelled in another way."""
    enrolled = R.enrollment(spark, sf).select("student_id", "period_ordinal", "enrollment_status")
    noisy = synthetic.with_noise(enrolled, ("student_id", "period_ordinal"), "enrollment_status", "period_ordinal", R.CALENDAR)
    late = noisy.where("landed_ordinal <> period_ordinal")
    forms = noisy.groupBy("student_id", "period_ordinal").agg(F.countDistinct("enrollment_status").alias("forms"))
    met = noisy.join(enrolled.withColumnRenamed("enrollment_status", "true"), ["student_id", "period_ordinal"])
    share = met.agg(F.avg((F.col("true") != F.col("enrollment_status")).cast("double"))).first()[0]
    return _lines(spark, [
        ("rows kept", noisy.select("student_id", "period_ordinal").distinct().join(enrolled, ["student_id", "period_ordinal"]).count()),
        ("late rows that lost their period", late.where("landed_ordinal <> period_ordinal + 1").count()),
        ("copies that differ", forms.where("forms > 1").count()), ("spellings out of hand", int(not 0.01 < share < 0.08)),
    ])


@query("SELECT unnest(['admissions', 'college', 'dropout', 'enrollment', 'graduation', 'program', 'shifter', 'student']) AS name, true AS same UNION ALL SELECT 'a source that fails has no manifest', true")
def source_run(spark: SparkSession, sf: str) -> DataFrame:
    """The generated source is written, validated and described; one that fails validation is not handed over."""
    root, calendar = files.scratch(spark), P.Calendar(2021, 2024)
    written = run.generate(spark, f"{root}/good", calendar, 10)
    told = json.loads(files.read_text(spark, f"{root}/good/manifest"))
    rows = [(n, told["rows"][n] == df.count() > 0 if n != "graduation" else told["rows"][n] == df.count()) for n, df in written.items()]
    failed = _fails(lambda: run.generate(spark, f"{root}/bad", P.Calendar(2021, 2024), 0), bronze.PipelineError)
    rows.append(("a source that fails has no manifest", failed and not files.exists(spark, f"{root}/bad/manifest")))
    return _lines(spark, rows, "name string, same boolean")


# --- models ---

_FIT = """n0 AS (SELECT *, period_ordinal % 2 AS s, CAST(period_ordinal AS DOUBLE) AS t, CAST(enrollment_count AS DOUBLE) AS y FROM train),
  sums AS (SELECT program_id, point, s, count(*) AS n, sum(t) AS st, sum(y) AS sy, sum(t * t) - sum(t) * sum(t) / count(*) AS tt, sum(t * y) - sum(t) * sum(y) / count(*) AS ty, sum(y * y) - sum(y) * sum(y) / count(*) AS yy FROM n0 GROUP BY ALL),
  whole AS (SELECT program_id, point, count(*) AS n, count(DISTINCT s) AS seasons, sum(t) AS st, sum(y) AS sy, sum(t * t) - sum(t) * sum(t) / count(*) AS tt, sum(t * y) - sum(t) * sum(y) / count(*) AS ty, sum(y * y) - sum(y) * sum(y) / count(*) AS yy FROM n0 GROUP BY ALL),
  inner_ AS (SELECT program_id, point, sum(tt) AS tt, sum(ty) AS ty, sum(yy) AS yy FROM sums GROUP BY ALL),
  slopes AS (SELECT w.program_id, w.point, w.n, w.n >= 4 AND w.seasons = 2 AS split, w.st, w.sy, CASE WHEN w.n >= 4 AND w.seasons = 2 THEN i.tt ELSE w.tt END AS tt, CASE WHEN w.n >= 4 AND w.seasons = 2 THEN i.ty ELSE w.ty END AS ty,
    CASE WHEN w.n >= 4 AND w.seasons = 2 THEN i.yy ELSE w.yy END AS yy FROM whole w JOIN inner_ i USING (program_id, point)),
  lines AS (SELECT *, CASE WHEN tt > 1e-9 THEN ty / tt ELSE 0 END AS slope FROM slopes),
  fitted AS (SELECT l.program_id, l.point, l.n, l.slope, CASE WHEN split THEN a.sy / a.n - slope * a.st / a.n ELSE (l.sy - slope * l.st) / l.n END AS base_0, CASE WHEN split THEN b.sy / b.n - slope * b.st / b.n ELSE (l.sy - slope * l.st) / l.n END AS base_1,
    sqrt(greatest(l.yy - slope * l.ty, 0) / greatest(l.n - CASE WHEN l.n >= 4 THEN 3 WHEN l.n > 1 THEN 2 ELSE 1 END, 1)) AS error
    FROM lines l LEFT JOIN sums a ON a.program_id = l.program_id AND a.point = l.point AND a.s = 0 LEFT JOIN sums b ON b.program_id = l.program_id AND b.point = l.point AND b.s = 1)"""
_NEXT = f"""{Q._COUNTS}, train AS (SELECT *, 1 + max(period_ordinal) OVER (PARTITION BY program_id) AS point FROM counts), {_FIT},
  ahead AS (SELECT program_id, CAST(point AS INTEGER) AS target_ordinal, CASE WHEN point % 2 = 0 THEN base_0 ELSE base_1 END + slope * point AS y, error FROM fitted)"""
_BAND = "round(greatest(y, 0), 4) AS yhat, round(greatest(y - 1.2815515655446004 * error, 0), 4) AS lower, round(greatest(y + 1.2815515655446004 * error, 0), 4) AS upper"


def _rounded(df: DataFrame, to: int = 4) -> DataFrame:
    return df.select(*[F.round(c, to).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"{_NEXT} SELECT program_id, target_ordinal, {_BAND} FROM ahead")
def forecast_by_sums(spark: SparkSession, sf: str) -> DataFrame:
    """The next period of each series by the fitted line and step, with its band."""
    return _rounded(fc.forecast_next(Q._program_counts(spark, sf), ["program_id"], "period_ordinal", "enrollment_count"))


_JUDGED = f"""{Q._FOLDS}, enough AS (SELECT program_id FROM counts GROUP BY 1 HAVING count(DISTINCT period_ordinal) >= 4),
  train AS (SELECT counts.*, t AS point FROM counts JOIN points ON period_ordinal < t), {_FIT},
  tried AS (SELECT f.*, CASE WHEN test_ordinal % 2 = 0 THEN base_0 ELSE base_1 END + slope * test_ordinal AS candidate FROM folds f JOIN enough USING (program_id) LEFT JOIN fitted ON fitted.program_id = f.program_id AND point = test_ordinal),
  judged AS (SELECT program_id, avg(abs(actual - candidate)) AS mae, avg(abs(actual - naive)) AS naive_mae, avg(abs(actual - historical_avg)) AS historical_avg_mae, avg(abs(actual - seasonal_naive)) AS seasonal_naive_mae FROM tried GROUP BY 1)"""


@query(f"""{_JUDGED} SELECT program_id, round(mae, 4) AS candidate_mae, round(naive_mae, 4) AS naive_mae, round(least(naive_mae, historical_avg_mae, seasonal_naive_mae), 4) AS best_baseline_mae,
  coalesce(mae < least(naive_mae, historical_avg_mae, seasonal_naive_mae), false) AS beats_best_baseline FROM judged""")
def fitted_evaluation_by_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Walk-forward errors of the fitted model beside the best baseline, for series that are long enough."""
    return _rounded(Q.fitted_evaluation(spark, sf).select("program_id", "candidate_mae", "naive_mae", "best_baseline_mae", "beats_best_baseline"))


@query(f"""{_JUDGED}, d AS (SELECT program_id, mae, least(naive_mae, historical_avg_mae) AS best FROM judged)
  SELECT p.program_id, 'bootstrap' AS gate, round(mae, 4) AS mae, round(best, 4) AS best_baseline_mae, CASE WHEN d.program_id IS NULL THEN NULL ELSE coalesce(mae < best, false) END AS promote,
  CASE WHEN d.program_id IS NULL THEN NULL WHEN coalesce(mae < best, false) THEN 'bootstrap' ELSE 'baseline' END AS reason FROM (SELECT DISTINCT program_id FROM counts) p LEFT JOIN d USING (program_id)""")
def deploy_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Gate, evaluation and promotion of every series that no model was trained for yet."""
    series = Q._program_counts(spark, sf).select("program_id", "period_ordinal", "enrollment_count")
    made = deploy.deploy(series, deploy.empty_registry(series, ["program_id"]), ["program_id"], "period_ordinal", "enrollment_count")
    return _rounded(made.decisions.select("program_id", "gate", "mae", "best_baseline_mae", "promote", "reason"))


@query(f"""{_JUDGED}, chosen AS (SELECT program_id FROM judged WHERE mae < least(naive_mae, historical_avg_mae))
  SELECT a.program_id, target_ordinal, yhat, lower, upper FROM chosen JOIN ({_NEXT} SELECT program_id, target_ordinal, {_BAND} FROM ahead) a USING (program_id)""")
def stored_champion_forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """Forecasts of the promoted models from a registry that was written and read: coefficients, no refit."""
    path = f"{files.scratch(spark)}/registry"
    series = Q._program_counts(spark, sf).select("program_id", "period_ordinal", "enrollment_count")
    made = deploy.deploy(series, deploy.empty_registry(series, ["program_id"]), ["program_id"], "period_ordinal", "enrollment_count")
    files.replace(made.registry, path)
    found = deploy.champion_forecasts(spark.read.parquet(path), ["program_id"])
    return _rounded(found.select("program_id", "target_ordinal", "yhat", "lower", "upper"))


@query("SELECT student_id, period_ordinal, CAST(row_number() OVER (ORDER BY student_id, period_ordinal) AS INTEGER) AS key FROM (SELECT DISTINCT o_custkey AS student_id, CAST(year(o_orderdate) AS INTEGER) AS period_ordinal FROM orders)")
def surrogate_keys_by_range(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers from 1 in order of the natural key, without one task for all rows."""
    rows = R.read(spark, sf, "orders").select(F.col("o_custkey").alias("student_id"), F.year("o_orderdate").alias("period_ordinal")).distinct()
    return dims.with_large_surrogate_key(rows, "key", ["student_id", "period_ordinal"])
