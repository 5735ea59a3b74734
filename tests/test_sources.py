"""Landing, publishing, synthetic data and streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from medlar.functions.periods import Calendar
from medlar.sources import bronze, files, synthetic
from medlar.streaming import landing

CAL = Calendar(2021, 2023)


def test_ingest_twice_then_drift_then_force(spark, tmp_path):
    root, log = str(tmp_path / "bronze"), bronze.RunLog(spark, str(tmp_path / "log"))
    df = spark.createDataFrame([("1", "a")], " ID string, Name string")
    run = lambda **k: bronze.ingest(log, root, "student", "2021", lambda: df, ["id", "name"], "x.csv", **k)["status"]
    assert [run(), run()] == ["SUCCESS", "SKIPPED"]
    whole = files.read_all_partitions(spark, f"{root}/student")
    assert whole.count() == 1
    assert set(bronze.AUDIT_COLUMNS) < set(whole.columns)
    assert [r["audit_status"] for r in bronze.audit(log.succeeded(), bronze.stored_batches(spark, root)).collect()] == ["OK"]
    files.delete(spark, bronze.unit_path(root, "student", "2021"))
    assert [r["audit_status"] for r in bronze.audit(log.succeeded(), bronze.stored_batches(spark, root)).collect()] == ["MISSING_OBJECT"]
    assert run() == "SUCCESS"
    assert log.read().where("status = 'DRIFT_DETECTED'").count() == 1
    assert run(force=True) == "SUCCESS"
    assert files.read_all_partitions(spark, f"{root}/student").count() == 2


def test_ingest_failures_are_logged(spark, tmp_path):
    root, log = str(tmp_path / "bronze"), bronze.RunLog(spark, str(tmp_path / "log"))
    df = spark.createDataFrame([("1",)], "id string")
    assert bronze.ingest(log, root, "e", "p", lambda: df, ["id", "name"])["status"] == "FAILED"
    assert bronze.ingest(log, root, "e", "p", lambda: df.limit(0), ["id"])["status"] == "FAILED"
    assert bronze.ingest(log, root, "e", "p", lambda: None, ["id"])["status"] == "NO_SOURCE_FILE"
    assert {r["status"]: r["n"] for r in log.tally().collect()} == {"FAILED": 2}
    with pytest.raises(ZeroDivisionError):
        log.tracked("gold", "kpi", lambda: 1 // 0)
    assert log.read().where("status = 'RUNNING' AND completed_at IS NULL").count() == 1


def test_append_once(spark, tmp_path):
    log = bronze.RunLog(spark, str(tmp_path / "log"))
    assert [log.append_once("silver", "e", "p", rows=3), log.append_once("silver", "e", "p")] == [True, False]
    assert log.read().count() == 1


def test_catalog_table(spark):
    files.save_table(spark.range(3), "medlar_test")
    files.save_table(spark.range(5), "medlar_test")
    assert spark.sql("SELECT count(*) AS n FROM medlar_test").first()["n"] == 5
    spark.sql("DROP TABLE medlar_test")


def test_csv(spark, tmp_path):
    folder = tmp_path / "2021" / "1"
    folder.mkdir(parents=True)
    (folder / "enrollment.csv").write_text(" Student_ID ,Units\n001,15\n")
    df = files.read_csv(spark, str(folder / "enrollment.csv"))
    assert [tuple(r) for r in df.collect()] == [("001", "15")]
    assert df.columns == ["student_id", "units"]
    assert files.read_csv(spark, str(folder / "other.csv")) is None
    assert files.read_csv_tree(spark, str(tmp_path), "enrollment.csv", ["a", "b"]).count() == 1
    with pytest.raises(FileNotFoundError):
        files.read_all_partitions(spark, str(tmp_path / "none"))


def test_replace_a_table_by_what_is_read_from_it(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).write.parquet(path)
    files.replace(spark.read.parquet(path).where("id < 4"), path)
    spark.catalog.clearCache()
    assert spark.read.parquet(path).count() == 4
    assert not files.write_quarantine(spark.range(0), str(tmp_path / "q"))


def test_publish_shows_one_version(spark, tmp_path):
    root = str(tmp_path / "gold")
    files.publish(spark, root, {"a": spark.range(3).withColumn("_hidden", F.lit(1))}, "v1")
    files.publish(spark, root, {"a": spark.range(5).withColumn("_hidden", F.lit(1))}, "v2")
    assert files.current(spark, root, "a").count() == 5
    assert files.current(spark, root, "a").columns == ["id"]


def test_reference_rows(spark):
    text = '{"colleges": [{"id": "A", "name": "Arts"}, {"id": "B"}]}'
    assert [tuple(r) for r in files.reference_rows(spark, text, "colleges", ["id", "name"], "id string, name string").collect()] == [("A", "Arts"), ("B", None)]
    with pytest.raises(ValueError, match="unknown"):
        files.reference_rows(spark, text, "colleges", ["id"], "id string")


def test_markdown(spark):
    df = spark.createDataFrame([("a", 1.0, -0.5), ("b", None, 0.5)], "s string, mae double, mae_diff double")
    assert files.markdown(df.orderBy("s")).splitlines()[2:] == ["| a | 1.00 | -0.50 |", "| b | n/a | +0.50 |"]


def test_synthetic_course_is_sound_and_repeatable(spark):
    entered = synthetic.students(spark, CAL, 100, 5)
    course = synthetic.progression(entered, CAL, 5)
    assert course.exceptAll(synthetic.progression(entered.repartition(5), CAL, 5)).isEmpty()
    assert synthetic.outcomes(course, entered).where("NOT balanced").isEmpty()
    assert course.groupBy("student_id", "period_ordinal").count().where("count > 1").isEmpty()
    other = synthetic.progression(entered, CAL, 5, seed=99)
    assert not course.exceptAll(other).isEmpty()
    noisy = synthetic.with_noise(course, ("student_id", "period_ordinal"), "status", "period_ordinal", CAL)
    assert noisy.count() > course.count()
    assert noisy.where("landed_ordinal > period_ordinal").count() > 0
    funnel = synthetic.admissions(course.where("year_level = 1"), ("program_id",))
    assert funnel.where("enrolled_freshmen > accepted OR accepted > applicants").isEmpty()


def test_stream_lands_the_latest(spark, tmp_path):
    source, root, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    schema = "k int, v string, at timestamp"
    first = spark.sql("SELECT 1 AS k, 'old' AS v, TIMESTAMP '2024-01-01' AS at UNION ALL SELECT 2, 'x', TIMESTAMP '2024-01-01'")
    first.write.mode("append").parquet(source)
    landing.land_latest(landing.arrivals(spark, source, schema), root, check, ["k"], "at").awaitTermination()
    spark.sql("SELECT 1 AS k, 'new' AS v, TIMESTAMP '2024-01-02' AS at").write.mode("append").parquet(source)
    landing.land_latest(landing.arrivals(spark, source, schema), root, check, ["k"], "at").awaitTermination()
    assert {r["k"]: r["v"] for r in spark.read.parquet(f"{root}/version=1").collect()} == {1: "new", 2: "x"}


def test_stream_drops_copies_and_counts_windows(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = spark.sql("SELECT CAST(id % 5 AS INT) AS k, TIMESTAMP '2024-01-01' + make_interval(0, 0, 0, CAST(id % 5 AS INT)) AS at FROM range(20)")
    rows.write.parquet(source)
    landing.run_to_parquet(landing.first_of_copies(landing.arrivals(spark, source, "k int, at timestamp"), ["k"], "at"), str(tmp_path / "out"), str(tmp_path / "c1"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    counts = landing.windowed_counts(landing.arrivals(spark, source, "k int, at timestamp"), "at", ["k"], "1 day", "1 hour")
    landing.run_to_parquet(counts, str(tmp_path / "out2"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "out2")).agg(F.sum("n")).first()[0] >= 12
