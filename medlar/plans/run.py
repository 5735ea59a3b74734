"""The whole way from a synthetic source to forecasts, as one library call."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medlar.functions.normalize import STATUSES
from medlar.functions.periods import Calendar
from medlar.operators import checks, rules
from medlar.plans import deploy, gold, reports, silver
from medlar.plans import features as feat
from medlar.sources import bronze, files, synthetic


@dataclass(frozen=True)
class Result:
    silver: dict[str, DataFrame]
    quarantine: DataFrame
    rejected: dict[str, DataFrame]
    gold: dict[str, DataFrame]
    features: DataFrame
    deployment: deploy.Deployment


def source(spark: SparkSession, calendar: Calendar, per_year: int, colleges: int = 4, programs: int = 12, seed: int = 42) -> dict[str, DataFrame]:
    """Extracts of all entities as text, as a registrar would hand them over, noise included."""
    college = spark.range(colleges).select(F.concat(F.lit("C"), "id").alias("college_id"), F.concat(F.lit(" College "), "id", F.lit(" ")).alias("college_name"))
    owner = lambda c: F.concat(F.lit("C"), F.pmod(c, F.lit(colleges)).cast("string"))
    named = lambda c: F.concat(F.lit("P"), c.cast("string"))
    program = spark.range(programs).select(named(F.col("id")).alias("program_id"), F.concat(F.lit("Program "), "id").alias("program_name"), owner(F.col("id")).alias("college_id"), F.lit("bachelor").alias("program_level"), F.lit("4.0").alias("nominal_duration_years"))
    entered = synthetic.students(spark, calendar, per_year, programs, seed)
    course = synthetic.progression(entered, calendar, programs, seed=seed + 1)
    student = entered.select(
        "student_id", F.col("cohort_year").alias("cohort_academic_year"), "gender", F.lit(2000).alias("birth_year"), F.lit("North").alias("home_province"), "admission_type",
        F.lit(1).alias("entry_year_level"), owner(F.col("entry_program_id")).alias("entry_college_id"), named(F.col("entry_program_id")).alias("entry_program_id"),
    )
    year, semester = calendar.year_of(F.col("period_ordinal")), calendar.semester_of(F.col("period_ordinal"))
    first = entered.select("student_id", ((F.col("cohort_year") - calendar.first_year) * 2).alias("__first"), F.col("entry_program_id").alias("__entry"))
    rows = course.join(first, "student_id").withColumn("academic_year", year).withColumn("semester_number", semester).withColumn("college_id", owner(F.col("program_id")))
    noisy = synthetic.with_noise(rows.withColumnRenamed("status", "enrollment_status"), ("student_id", "period_ordinal"), "enrollment_status", "period_ordinal", calendar)
    pid = named(F.col("program_id")).alias("program_id")
    enrollment = noisy.select("student_id", "academic_year", "semester_number", "college_id", pid, "enrollment_status", "year_level", F.lit(18).alias("units_enrolled"), (F.col("period_ordinal") == F.col("__first")).alias("is_new_enrollee"), "landed_ordinal")
    graduation = rows.where("status = 'GRADUATED'").select("student_id", "academic_year", "semester_number", pid, "college_id", ((F.col("period_ordinal") - F.col("__first") + 1) / 2).alias("years_to_complete"))
    dropout = rows.where("status = 'DROPPED'").select("student_id", "academic_year", "semester_number", pid, "college_id", F.lit("unknown").alias("dropout_reason"), (F.col("period_ordinal") - F.col("__first")).alias("semesters_completed_before_dropout"))
    shifter = rows.withColumn("__before", F.expr("lag(program_id) OVER (PARTITION BY student_id ORDER BY period_ordinal)")).where("__before <> program_id")
    shifter = shifter.select("student_id", "academic_year", "semester_number", named(F.col("__before")).alias("from_program_id"), named(F.col("program_id")).alias("to_program_id"))
    fresh = entered.select(owner(F.col("entry_program_id")).alias("college_id"), named(F.col("entry_program_id")).alias("program_id"), F.col("cohort_year").alias("academic_year"))
    admissions = synthetic.admissions(fresh, ("college_id", "program_id", "academic_year"), seed + 3).select(*silver.ENTITIES["admissions"])
    made = {"college": college, "program": program, "student": student, "admissions": admissions, "enrollment": enrollment, "graduation": graduation, "dropout": dropout, "shifter": shifter}
    return {n: df.select([F.col(c).cast("string").alias(c) for c in df.columns]) for n, df in made.items()}


def manifest(extracts: dict[str, DataFrame], seed: int) -> str:
    """Seed, row counts and fingerprints of a generated source."""
    prints = {n: checks.portable_fingerprint(df).first() for n, df in sorted(extracts.items())}
    return json.dumps({"seed": seed, "rows": {n: p["rows"] for n, p in prints.items()}, "fingerprints": {n: str(p["sum"]) for n, p in prints.items()}}, sort_keys=True)


def validate_source(extracts: dict[str, DataFrame], calendar: Calendar) -> list[str]:
    """What keeps a generated source from being handed over: anything but the repeated rows and spellings that belong to its
    noise, students who aren't in exactly one state at the end, and funnels that widen."""
    report = {r["check"]: r["found"] for r in reports.pre_ingestion(extracts, calendar).collect()}
    problems = [f"{check}: {found}" for check, found in report.items() if found and not check.endswith("_repeated_rows")]
    gone = extracts["graduation"].select("student_id").union(extracts["dropout"].select("student_id"))
    twice = checks.not_unique(gone, ["student_id"]).count()
    if twice:
        problems.append(f"students who left twice: {twice}")
    funnel = extracts["admissions"].select(*[F.col(c).try_cast("int").alias(c) for c in ("applicants", "accepted", "enrolled_freshmen")])
    wide = funnel.where(~rules.funnel("applicants", "accepted", "enrolled_freshmen")).count()
    return problems + ([f"funnels that widen: {wide}"] if wide else [])


def generate(spark: SparkSession, root: str, calendar: Calendar, per_year: int, seed: int = 42, **size: int) -> dict[str, DataFrame]:
    """Write the synthetic source as CSV below ``root``, with its manifest, and read it back. A source that fails validation
    raises and has no manifest."""
    extracts = source(spark, calendar, per_year, seed=seed, **size)
    for name, df in extracts.items():
        df.write.mode("overwrite").option("header", True).csv(f"{root}/{name}")
    written = {n: files.read_csv(spark, f"{root}/{n}") for n in extracts}
    problems = validate_source(written, calendar)
    if problems:
        raise bronze.PipelineError("; ".join(problems), "DATA_QUALITY_FAILURE")
    spark.createDataFrame([(manifest(written, seed),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/manifest")
    return written


def land(spark: SparkSession, root: str, extracts: dict[str, DataFrame]) -> bronze.RunLog:
    """Every extract as a unit of the landing area; enrollment by the period in which it arrived."""
    log = bronze.RunLog(spark, f"{root}/log")
    for name, df in extracts.items():
        columns = list(silver.ENTITIES[name])
        parts = sorted(r[0] for r in df.select("landed_ordinal").distinct().collect()) if "landed_ordinal" in df.columns else [None]
        for part in parts:
            own = df if part is None else df.where(F.col("landed_ordinal") == part)
            result = bronze.ingest(log, f"{root}/bronze", name, part or "all", lambda d=own, c=columns: d.select(*c), columns, source=name)
            if result["status"] == "FAILED":
                raise bronze.IngestionError(result["message"])
    return log


def build(spark: SparkSession, root: str, calendar: Calendar) -> Result:
    """Silver, gold, features and forecasts from what has landed; gates are held before anything is published."""

    def stored(name: str, df: DataFrame) -> DataFrame:
        files.replace(df, f"{root}/silver/{name}")
        return spark.read.parquet(f"{root}/silver/{name}")

    clean = {n: stored(n, silver.clean(files.read_all_partitions(spark, f"{root}/bronze/{n}"), n).rows) for n in silver.ENTITIES}
    landed = clean["enrollment"].count()
    tagged = silver.validate_enrollment(clean["enrollment"], clean["student"], clean["dropout"], calendar).persist()
    kept = tagged.count()
    if landed and 1 - kept / landed > rules.MOST_QUARANTINED:
        raise bronze.PipelineError(f"{1 - kept / landed:.0%} of enrollment are repeats", "DUPLICATE_DATA")
    valid, quarantine = rules.split(tagged)
    share = quarantine.count() / max(kept, 1)
    if share > rules.MOST_QUARANTINED:
        raise rules.GateError(f"{share:.0%} of enrollment is quarantined")
    quarantine = stored("quarantine", quarantine)
    clean["enrollment"] = valid.drop("period_ordinal")
    rejected = {}
    for name in [n for n in silver.ENTITIES if n not in ("college", "student")]:
        judged, chain = silver.business_rules(name, clean[name], clean["program"], clean["college"], calendar)
        judged = stored(f"{name}_judged", judged)
        rules.enforce(judged, chain)
        clean[name], rejected[name] = rules.split(judged)
    tables = gold.build(spark, clean, calendar)
    counts = feat.aligned_counts(
        tables["fact_enrollment"].withColumn("semester_number", calendar.semester_of(F.col("period_ordinal"))), tables["fact_graduation"].withColumn("semester_number", calendar.semester_of(F.col("period_ordinal"))),
        ["college_key", "program_key", "period_ordinal", "semester_number"], ("enrollment_count", "graduation_count"),
    )
    made = feat.features(counts, ["college_key", "program_key"], "period_ordinal", "semester_number", ["enrollment_count", "graduation_count"])
    series = made.select("program_key", "period_ordinal", "enrollment_count")
    return Result(clean, quarantine, rejected, tables, made, deploy.deploy(series, deploy.empty_registry(series, ["program_key"]), ["program_key"], "period_ordinal", "enrollment_count"))


def constraints() -> dict:
    """Keys, references, vocabularies and ranges that gold tables keep, each as the rows that break it."""
    unique = {
        "dim_college": ["college_key"], "dim_program": ["program_key"], "dim_student": ["student_key"], "dim_academic_period": ["academic_period_key"],
        "fact_enrollment": ["student_key", "academic_period_key"], "fact_retention": ["student_key", "academic_period_key"], "fact_institution_kpi": ["college_key", "period_ordinal"],
    }
    children = {"fact_enrollment": ("student", "college", "program", "academic_period"), "fact_graduation": ("student", "college", "program"), "fact_dropout": ("student", "college", "program"), "fact_shifter": ("student",)}
    made = {f"unique:{t}": lambda x, t=t, k=k: checks.not_unique(x[t], k) for t, k in unique.items()}
    for fact, parents in children.items():
        for parent in parents:
            key = f"{parent}_key"
            made[f"references:{fact}.{key}"] = lambda x, f=fact, p=parent, k=key: checks.orphans(x[f].select(k), x[f"dim_{p}"], k, k)
    made["one_current_spell"] = lambda x: checks.not_unique(x["dim_student"].where("is_current"), ["student_id"])
    made["accepted_values:enrollment_status"] = lambda x: x["fact_enrollment"].where(checks.accepted_values("enrollment_status", STATUSES).broken)
    made["one_champion"] = lambda x: checks.not_unique(x["registry"].where("is_champion"), ["program_key", "metric"])
    return made


def publish(spark: SparkSession, root: str, result: Result, version: str) -> None:
    """Gold tables, features, registry and forecasts as one version that keeps its constraints; rejected rows beside them."""
    files.write_quarantine(result.quarantine, f"{root}/quarantine/enrollment")
    for name, df in result.rejected.items():
        files.write_quarantine(df, f"{root}/quarantine/business_rules/{name}")
    files.publish(spark, f"{root}/gold", result.gold | {"features": result.features, "registry": result.deployment.registry, "forecasts": result.deployment.forecasts}, version, constraints())
