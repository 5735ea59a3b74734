"""The operators on tiny tables with known results."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from medlar.functions import normalize as N
from medlar.functions import periods as P
from medlar.operators import checks, dedupe, dims, facts, kpi, rules
from medlar.plans import features, marts
from medlar.plans import forecasting as fc

CAL = P.Calendar(2021, 2023)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [("ENROLLED", "ENROLLED"), ("Enrolled", "ENROLLED"), (" ENROLLED ", "ENROLLED"), ("\tgraduated\n", "GRADUATED"), ("Dropped", "DROPPED"), ("dropped out", "DROPPED"), ("SUSPENDED", "UNKNOWN:SUSPENDED"), (None, None)],
)
def test_status(spark, raw, clean):
    assert one(spark, N.status(F.lit(raw).cast("string"))) == clean


@pytest.mark.parametrize(("raw", "clean"), [("1", "1"), (" 2 ", "2"), ("1st Semester", "1"), ("2ND semester", "2"), ("3rd Semester", "3rd Semester"), ("garbage", "garbage"), (None, None)])
def test_semester(spark, raw, clean):
    assert one(spark, N.semester(F.lit(raw).cast("string"))) == clean


@pytest.mark.parametrize(("raw", "number"), [("7", 7), ("2021.0", 2021), ("1.5", None), ("x", None), ("", None), (None, None)])
def test_whole_number(spark, raw, number):
    assert one(spark, N.whole_number(F.lit(raw).cast("string"))) == number


@pytest.mark.parametrize(("raw", "year"), [("2021-2022", 2021), ("2021", 2021), ("abc", None), (None, None)])
def test_start_year(spark, raw, year):
    assert one(spark, P.start_year(F.lit(raw).cast("string"))) == year


def test_periods(spark):
    rows = dims.academic_periods(spark, CAL).orderBy("period_ordinal").collect()
    assert len(rows) == 6
    assert all(r["academic_period_key"] == r["period_ordinal"] + 1 for r in rows)
    assert rows[3]["period_label"] == "2022-2023 · 2nd Semester"
    assert dims.calendar_days(spark, CAL).count() == 1095


@pytest.mark.parametrize(("level", "duration", "label"), [(0, 4.0, "Freshman"), (2, 4.0, "Sophomore"), (4, 3.0, "Senior"), (5, 4.0, "Super Senior"), (5, 5.0, "Senior")])
def test_year_level_label(spark, level, duration, label):
    assert one(spark, P.year_level_label(F.lit(level), F.lit(duration))) == label


def test_last_write_wins(spark):
    df = spark.createDataFrame([("S1", 1, 15, 0), ("S1", 1, 21, 100), ("S1", 2, 9, 5), (None, 1, 1, 1), (None, 1, 2, 2)], "s string, sem int, units int, at int")
    assert sorted(tuple(r) for r in dedupe.last_write_wins(df, ["s", "sem"], "at").where("s IS NOT NULL").collect()) == [("S1", 1, 21, 100), ("S1", 2, 9, 5)]
    assert dedupe.last_write_wins(df, ["s", "sem"], "at").count() == 3


def test_collapse_copies(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", None, 2), ("b", 1, 1)], "k string, v int, at int")
    assert sorted(tuple(r) for r in dedupe.collapse_copies(df, ["at"], "at").collect()) == [("a", None, 2), ("b", 1, 1)]


def test_rules_split_the_input(spark):
    df = spark.range(100).withColumn("v", F.when(F.col("id") % 10 != 0, F.col("id")))
    chain = [rules.Rule("known", F.col("v").isNotNull()), rules.Rule("small", F.col("v") < 50), rules.Rule("odd", F.col("v") % 2 == 1, null_passes=True)]
    tagged = rules.tag(df, chain)
    valid, bad = rules.split(tagged)
    assert valid.count() + bad.count() == 100
    report = {r["rule"]: (r["checked"], r["failed"], r["passed"]) for r in rules.gate_report(tagged, chain).collect()}
    assert report == {"known": (100, 10, True), "small": (90, 45, False), "odd": (45, 20, False)}
    with pytest.raises(rules.GateError):
        rules.enforce(tagged, chain)
    rules.enforce(tagged, chain[:1])
    assert rules.tag(df, []).where(F.col(rules.FAILED).isNotNull()).isEmpty()


def test_progression(spark):
    df = spark.createDataFrame([("n", 0, 1), ("n", 1, 2), ("s", 0, 1), ("s", 1, 1), ("j", 0, 1), ("j", 1, 3), ("d", 0, 2), ("d", 1, 1), ("g", 0, 1), ("g", 2, 4)], "s string, o int, l int")
    assert {r["s"] for r in facts.illegal_transitions(df, "s", "o", "l").where("is_illegal").collect()} == {"j", "d"}


def spells_by_hand(entry, changes):
    out = []
    for s, (start, program) in entry.items():
        at, now = start, program
        for o, to in sorted(changes.get(s, [])):
            if o == start:
                now = to
                continue
            out.append((s, now, at, o - 1))
            at, now = o, to
        out.append((s, now, at, None))
    return sorted(out, key=str)


def test_spells(spark):
    rng = random.Random(5)
    entry = {s: (rng.randrange(3), f"p{rng.randrange(4)}") for s in range(60)}
    changes = {s: [(o, f"q{rng.randrange(4)}") for o in sorted(rng.sample(range(start, 8), rng.randrange(3)))] for s, (start, _) in entry.items()}
    first = spark.createDataFrame([(s, o, p) for s, (o, p) in entry.items()], "s int, o int, p string")
    later = spark.createDataFrame([(s, o, p) for s, x in changes.items() for o, p in x], "s int, o int, to string")
    got = dims.spells(first, later, "s", "o", "p", "to").collect()
    assert sorted([(r["s"], r["p"], r["valid_from"], r["valid_to"]) for r in got], key=str) == spells_by_hand(entry, changes)
    current = [r["s"] for r in got if r["is_current"]]
    assert len(current) == len(set(current)) == 60


def test_as_of(spark):
    history = spark.createDataFrame([("S1", 1, 0, 0, False), ("S1", 2, 1, None, True), ("S2", 3, 0, None, True)], "s string, key int, valid_from int, valid_to int, is_current boolean")
    rows = spark.createDataFrame([("S1", 0), ("S1", 1), ("S2", 0), ("S2", 5), ("S3", 0)], "s string, o int")
    assert sorted((r["s"], r["o"], r["key"]) for r in facts.as_of_join(rows, history, "s", "o").collect()) == [("S1", 0, 1), ("S1", 1, 2), ("S2", 0, 3), ("S2", 5, 3)]
    assert [r["s"] for r in facts.outside_history(rows, history, "s", "o").collect()] == ["S3"]


def test_unresolved_keys_raise(spark):
    rows = spark.createDataFrame([(1, None), (2, 5)], "a int, b int")
    with pytest.raises(facts.UnresolvedKeyError):
        facts.require_keys(rows, ["a", "b"])
    assert facts.require_keys(rows, ["a"]) is rows


def test_retention(spark):
    rows = spark.createDataFrame([("a", 0, "ENROLLED"), ("a", 1, "GRADUATED"), ("b", 0, "ENROLLED"), ("b", 1, "DROPPED"), ("c", 0, "ENROLLED"), ("c", 2, "ENROLLED"), ("d", 5, "ENROLLED")], "s string, o int, st string")
    got = {(r["s"], r["o"]): r["is_retained"] for r in facts.retention(rows, "s", "o", "st", 5).collect()}
    assert got == {("a", 0): 1, ("b", 0): 0, ("b", 1): 0, ("c", 0): 0, ("c", 2): 0}


@pytest.mark.parametrize(("rates", "score"), [((0.22, 0.88, 0.06, 0.80, 0.97, 0.95), 69.0), ((1, 1, 0, 1, 1, 1), 100.0), ((0, 0, 1, 0, 0, 0), 0.0)])
def test_success_rate(spark, rates, score):
    df = spark.createDataFrame([tuple(map(float, rates))], ", ".join(f"{c} double" for c in kpi.WEIGHTS))
    assert df.select(kpi.success_rate().alias("x")).first()["x"] == score


def test_kpi_of_a_group_without_enrollment_is_null(spark):
    columns = "g int, o int, enrolled int, eligible int, graduated int, dropped int, shifted int, retained int, moved_up int"
    df = spark.createDataFrame([(1, 0, 0, 0, 1, 0, 0, None, None), (1, 1, 1, 1, 0, 0, 0, 1, None)], columns)
    rows = {r["o"]: r for r in kpi.institution_kpi(df, ["g"], "o").collect()}
    assert rows[0]["success_rate"] is None
    assert rows[1]["enrollment_stability"] == 1.0


def test_features_never_look_ahead(spark):
    df = spark.createDataFrame([(1, 0, 1, 10), (1, 1, 2, 12), (1, 2, 1, 15), (1, 3, 2, 999)], "p int, o int, sem int, n int")
    rows = features.features(df, ["p"], "o", "sem", ["n"]).orderBy("o").collect()
    made = [c for c in rows[0].asDict() if c.startswith("n_")]
    assert all(rows[0][c] is None for c in made)
    assert all(r[c] != 999 for r in rows for c in made)
    assert rows[3]["n_lag_1"] == 15
    assert rows[3]["n_rolling_avg_2"] == 13.5
    assert rows[3]["n_seasonality"] == 12
    assert rows[2]["n_trend"] == 2


def test_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (None, "zz")], "k int, v string")
    found = {r["check"]: r["violations"] for r in checks.violations(df, [checks.not_null("k"), checks.accepted_values("v", ["a", "b"]), checks.in_range("k", 2), checks.matches("v", "^.$")]).collect()}
    assert found == {"not_null:k": 1, "accepted_values:v": 1, "in_range:k": 2, "matches:v": 1}
    assert [tuple(r) for r in checks.not_unique(df, ["k"]).collect()] == [(1, 2)]
    assert checks.orphans(df, spark.range(2), "k", "id").count() == 1
    assert checks.schema_differences(df, ["k", "w"]) == {"missing": ["w"], "extra": ["v"]}


def test_fingerprint_ignores_order(spark):
    df = spark.range(1000).withColumn("v", F.col("id") * 3)
    assert checks.fingerprint(df).first() == checks.fingerprint(df.repartition(7).orderBy(F.desc("id"))).first()
    assert checks.fingerprint(df).first() != checks.fingerprint(df.withColumn("v", F.col("v") + 1)).first()


def test_errors_by_hand(spark):
    df = spark.createDataFrame([(10.0, 12.0), (0.0, 1.0), (20.0, 17.0)], "actual double, p double")
    got = df.agg(*[c.alias(n) for n, c in fc.errors("actual", "p").items()]).first()
    assert got["mae"] == pytest.approx(2)
    assert got["rmse"] == pytest.approx((14 / 3) ** 0.5)
    assert got["mape"] == pytest.approx(100 * (0.2 + 0.15) / 2)
    assert got["r2"] == pytest.approx(1 - 14 / 200)
    flat = spark.createDataFrame([(5.0, 5.0), (5.0, 5.0)], "actual double, p double")
    assert flat.agg(fc.errors("actual", "p")["r2"].alias("r2")).first()["r2"] == 1.0


def test_gates(spark):
    now = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5), ("d", 5)], "p string, current_max int")
    then = spark.createDataFrame([("b", 4), ("c", 5), ("d", 6)], "p string, last_trained int")
    got = {r["p"]: (r["retrain"], r["reason"]) for r in fc.retrain_gate(now, then, ["p"]).collect()}
    assert got == {"a": (True, "bootstrap"), "b": (True, "new_period"), "c": (False, "unchanged"), "d": (False, "regressed")}
    candidates = spark.createDataFrame([("a", 1.0, 2.0), ("b", 2.0, 2.0), ("c", 1.0, 2.0), ("d", 1.0, 2.0)], "p string, mae double, best_baseline_mae double")
    champions = spark.createDataFrame([("c", 1.0), ("d", 0.5)], "p string, mae double")
    assert {r["p"]: r["promote"] for r in fc.promotion(candidates, champions, ["p"]).collect()} == {"a": True, "b": False, "c": True, "d": False}


def test_forecast_of_a_line(spark):
    df = spark.createDataFrame([(1, t, 10.0 + 2 * t + (t % 2)) for t in range(8)] + [(2, 0, 3.0)], "p int, o int, n double")
    got = {r["p"]: r for r in fc.forecast_next(df, ["p"], "o", "n").collect()}
    assert got[1]["yhat"] == pytest.approx(26)
    assert got[2]["yhat"] == pytest.approx(3)
    assert fc.series_problems(df, ["p"], "o", "n").where("rows > 0").isEmpty()


def test_weighted_average(spark):
    df = spark.createDataFrame([(90, 1.0), (10, 0.0)], "w int, v double")
    assert df.agg(marts.weighted_average("v", "w").alias("x")).first()["x"] == 0.9
    assert df.where("w > 100").agg(marts.weighted_average("v", "w").alias("x")).first()["x"] is None


def test_chronological_order(spark):
    df = spark.createDataFrame([("2022-2023", "1st Semester"), ("2021-2022", "2nd Semester"), ("2021-2022", "1st Semester")], "y string, s string")
    assert [tuple(r) for r in marts.chronological(df, "y", "s").collect()] == [("2021-2022", "1st Semester"), ("2021-2022", "2nd Semester"), ("2022-2023", "1st Semester")]


def test_partition_part(spark):
    key = F.lit("academic_year=2021-2022/semester=1")
    assert one(spark, P.partition_part(key, "academic_year")) == "2021-2022"
    assert one(spark, P.partition_part(key, "semester")) == "1"
    assert one(spark, P.partition_part(key, "year")) is None


@pytest.mark.parametrize(("x", "y"), [(0, 1.0), (1, 1.0), (2, 2.0), (4, 4.0), (9, 4.0)])
def test_interpolate(spark, x, y):
    assert one(spark, P.interpolate(F.lit(float(x)), [(1, 1.0), (3, 3.0), (4, 4.0)])) == y


def test_canonical_contract_names_what_is_wrong(spark):
    row = ("2021-22", "Summer", "C", "P", "Female", None, -1, None, None, 3, 0, 0, 0)
    kinds = ["string"] * 6 + ["int"] * 7
    df = spark.createDataFrame([row], ", ".join(f"{c} {k}" for c, k in zip(marts.CANONICAL, kinds, strict=True)))
    broken = {r["check"] for r in marts.canonical_violations(df).where("violations > 0").collect()}
    assert broken == {"matches:academic_year", "accepted_values:semester", "not_null:year_level", "in_range:freshmen_count"}
    with pytest.raises(ValueError, match="missing"):
        marts.canonical_violations(df.drop("gender"))
