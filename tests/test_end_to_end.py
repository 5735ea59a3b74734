"""Cleaning, validation, the star schema and deployment, and the whole way through."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from medlar.functions.periods import Calendar
from medlar.operators import checks, rules
from medlar.plans import deploy, reports, run, silver
from medlar.plans import forecasting as fc
from medlar.sources import files

CAL = Calendar(2021, 2026)


def enrollment(spark, rows):
    columns = list(silver.ENTITIES["enrollment"])
    made = [(s, y, t, "C", "P", st, str(lv), u, "true", at) for s, y, t, st, lv, u, at in rows]
    return spark.createDataFrame(made, ", ".join(f"{c} string" for c in columns) + ", at int").withColumn("_ingested_at", F.expr("timestamp_seconds(at)")).drop("at")


def test_clean(spark):
    landed = enrollment(spark, [("S1", "2021-2022", "1st Semester", " enrolled ", 1, " 18 ", 0), ("S1", "2021-2022", "1", "ENROLLED", 1, "18", 9), ("S2", "2021", "2nd", "SUSPENDED", 1, "x", 0), ("  ", "?", "3", None, 1, "15", 0)])
    got = silver.clean(landed, "enrollment")
    assert got.rows.count() == 3
    row = got.rows.where("student_id = 'S1'").first()
    assert (row["academic_year"], row["semester_number"], row["enrollment_status"], row["units_enrolled"], row["is_new_enrollee"]) == (2021, 1, "ENROLLED", 18, True)
    stats = got.stats.first()
    assert (stats["rows"], stats["unknown_status"], stats["coercion_failures"], stats["duplicates_dropped"]) == (4, 1, 2, 1)
    again = silver.clean(got.rows, "enrollment").rows
    assert again.exceptAll(got.rows).where("enrollment_status NOT LIKE 'UNKNOWN:%'").isEmpty()


def test_validation_chain(spark):
    rows = [
        ("ok", "2021", "1", "ENROLLED", 1, "1", 0), ("ok", "2021", "2", "ENROLLED", 2, "1", 0), ("ok", "2021", "2", "ENROLLED", 1, "1", 5), ("unk", "2021", "1", "X", 1, "1", 0),
        ("early", "2021", "1", "ENROLLED", 1, "1", 0), ("nobody", "2021", "1", "ENROLLED", 1, "1", 0), ("gone", "2021", "1", "DROPPED", 1, "1", 0), ("gone2", "2021", "1", "DROPPED", 1, "1", 0),
        ("jump", "2021", "1", "ENROLLED", 1, "1", 0), ("jump", "2021", "2", "ENROLLED", 3, "1", 0),
        ("skip", "2021", "1", "ENROLLED", 1, "1", 0), ("skip", "2021", "2", "X", 2, "1", 0), ("skip", "2022", "1", "ENROLLED", 3, "1", 0),
    ]
    clean = silver.clean(enrollment(spark, rows), "enrollment").rows
    students = spark.createDataFrame([(s, 2023 if s == "early" else 2021) for s in ("ok", "unk", "early", "gone", "gone2", "jump", "skip")], "student_id string, cohort_academic_year int")
    dropouts = spark.createDataFrame([("gone", 2021, 1)], "student_id string, academic_year int, semester_number int")
    tagged = silver.validate_enrollment(clean, students, dropouts, CAL)
    got = {(r["student_id"], r["academic_year"], r["semester_number"]): r[rules.FAILED] for r in tagged.collect()}
    assert got == {
        ("ok", 2021, 1): None, ("ok", 2021, 2): None, ("unk", 2021, 1): "known_status", ("early", 2021, 1): "cohort_range", ("nobody", 2021, 1): "cohort_range", ("gone", 2021, 1): None,
        ("gone2", 2021, 1): "dropout_event", ("jump", 2021, 1): None, ("jump", 2021, 2): "progression", ("skip", 2021, 1): None, ("skip", 2021, 2): "known_status", ("skip", 2022, 1): None,
    }
    assert silver.duplicate_share(clean, tagged) == pytest.approx(1 / 13)


def test_business_rules(spark):
    programs = spark.createDataFrame([("P", "C", 4.0)], "program_id string, college_id string, nominal_duration_years double")
    colleges = spark.createDataFrame([("C",)], "college_id string")
    rows = spark.createDataFrame(
        [("ok", 2021, 1, "C", "P", 6, 3), ("sem", 2021, 3, "C", "P", 1, 3), ("year", 1999, 1, "C", "P", 1, 3), ("drift", 2021, 1, "D", "P", 1, 3), ("lvl", 2021, 1, "C", "P", 7, 3), ("neg", 2021, 1, "C", "P", 1, -1), ("null", 2021, 1, "C", "P", None, 3)],
        "student_id string, academic_year int, semester_number int, college_id string, program_id string, year_level int, units_enrolled int",
    )
    tagged, chain = silver.business_rules("enrollment", rows, programs, colleges, CAL)
    assert {r["student_id"]: r[rules.FAILED] for r in tagged.collect()} == {"ok": None, "sem": "semester_number", "year": "academic_year", "drift": "program_college", "lvl": "year_level", "neg": "non_negative", "null": "year_level"}
    assert rules.gate_report(tagged, chain).count() == len(chain)
    moved = spark.createDataFrame([("a", 2021, 1, "P", "Q")], "student_id string, academic_year int, semester_number int, from_program_id string, to_program_id string")
    assert silver.business_rules("shifter", moved, programs, colleges, CAL)[0].first()[rules.FAILED] == "to_program_id"
    funnel = spark.createDataFrame([(5, 9, 1)], "applicants int, accepted int, enrolled_freshmen int")
    assert silver.business_rules("admissions", funnel, programs, colleges, CAL)[0].first()[rules.FAILED] == "funnel"


def test_deploy_promotes_what_beats_the_baselines(spark):
    line = [(1, t, 10.0 + 5 * t) for t in range(8)]
    flat = [(2, t, 7.0) for t in range(8)]
    series = spark.createDataFrame(line + flat + [(3, 7, 1.0)], "p int, o int, n double")
    first = deploy.deploy(series, deploy.empty_registry(series, ["p"]), ["p"], "o", "n")
    got = {r["p"]: r for r in first.decisions.collect()}
    assert got[1]["promote"]
    assert not got[2]["promote"]  # a tie with the baseline is no win
    assert got[3]["promote"] is None  # too short
    assert {r["p"]: round(r["yhat"]) for r in first.forecasts.collect()} == {1: 50}
    registry = spark.createDataFrame(first.registry.withColumn("mae", F.lit(1.0)).collect(), first.registry.schema)
    again = deploy.deploy(series, registry, ["p"], "o", "n")
    assert {r["p"]: r["gate"] for r in again.decisions.collect()} == {1: "unchanged", 2: "unchanged", 3: "bootstrap"}
    assert again.forecasts.isEmpty()
    longer = series.union(spark.createDataFrame([(1, 8, 50.0)], series.schema))
    third = deploy.deploy(longer, registry, ["p"], "o", "n")
    champions = third.registry.where("is_champion").collect()
    assert [(r["p"], r["trained_to"]) for r in champions] == [(1, 8)]
    assert fc.newest(third.registry, ["p"]).where("p = 1").first()["trained_to"] == 8
    assert deploy.report(first.decisions, ["p"]).count() == 3
    assert deploy.deploy(series.limit(0), registry, ["p"], "o", "n").forecasts.isEmpty()


def test_whole_way(spark, tmp_path):
    root = str(tmp_path)
    extracts = run.source(spark, CAL, 60)
    assert json.loads(run.manifest(extracts, 42))["rows"]["student"] == 360
    found = {r["check"]: r["found"] for r in reports.pre_ingestion(extracts, CAL).collect()}
    assert found["enrollment_repeated_rows"] > 0
    assert found["enrollment_columns"] == found["enrollment_orphans"] == found["uncovered_periods"] == found["illegal_transitions"] == 0
    assert reports.weights_problem({"a": 0.5, "b": 0.5}, {"a", "b"}) is None
    assert reports.weights_problem({"a": 0.5}, {"a"})
    log = run.land(spark, root, extracts)
    assert {r["status"] for r in log.tally().collect()} == {"SUCCESS"}
    run.land(spark, root, extracts)
    assert log.read().count() == log.succeeded().count()
    result = run.build(spark, root, CAL)
    fact = result.gold["fact_enrollment"]
    assert fact.count() == result.silver["enrollment"].count()
    assert checks.not_unique(fact, ["student_key", "academic_period_key"]).isEmpty()
    assert result.quarantine.where("failed_rule IS NULL").isEmpty()
    assert result.gold["fact_institution_kpi"].where("success_rate < 0 OR enrollment_stability > 1").isEmpty()
    assert result.gold["dim_student"].where("is_current").count() == 360
    run.publish(spark, root, result, "v1")
    assert files.current(spark, f"{root}/gold", "fact_enrollment").count() == fact.count()
    assert len(list((tmp_path / "gold/versions/v1").iterdir())) == 16
