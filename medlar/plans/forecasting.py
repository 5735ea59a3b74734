"""Forecasts per series: baselines and walk-forward evaluation in SQL terms, a fitted trend with a seasonal step, and the
registry of candidates and champions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medlar.operators.dedupe import latest_per_key

FOLDS = 3
SEASON = 2
LEAST_PERIODS = 4
#: Normal quantile of an 80 % interval.
BAND = 1.2815515655446004


def fold_points(series: DataFrame, ordinal: str, folds: int = FOLDS) -> DataFrame:
    """(test_ordinal): the last ordinals of the whole table, the same for every series."""
    last = series.agg(F.max(ordinal).alias("last")).where("last IS NOT NULL")
    return last.select(F.explode(F.sequence((F.col("last") - (folds - 1)).cast("int"), F.col("last").cast("int"))).alias("test_ordinal"))


def _at_points(series: DataFrame, ordinal: str, folds: int) -> DataFrame:
    """Each row once for every test point that isn't before it, with column test_ordinal."""
    last = series.agg(F.max(ordinal)).first()[0]
    points = [] if last is None else range(int(last) - folds + 1, int(last) + 1)
    points = F.array(*[F.lit(p) for p in points]).cast("array<int>")
    return series.withColumn("test_ordinal", F.explode(points)).where(F.col(ordinal) <= F.col("test_ordinal"))


def baselines(series: DataFrame, key: Sequence[str], ordinal: str, value: str, folds: int = FOLDS) -> DataFrame:
    """(key, test_ordinal, actual, naive, historical_avg, seasonal_naive) for folds that the series has a row of and rows
    before. The test points are a handful; each series row meets each of them once, inside one aggregation."""
    met = _at_points(series, ordinal, folds)
    earlier = F.col(ordinal) < F.col("test_ordinal")
    y = F.col(value).cast("double")
    return met.groupBy(*key, "test_ordinal").agg(
        F.max(F.when(~earlier, y)).alias("actual"), F.max_by(F.when(earlier, y), F.when(earlier, F.col(ordinal))).alias("naive"),
        F.avg(F.when(earlier, y)).alias("historical_avg"), F.max(F.when(F.col(ordinal) == F.col("test_ordinal") - SEASON, y)).alias("seasonal_naive"),
    ).where("actual IS NOT NULL AND naive IS NOT NULL")


def errors(actual: str, predicted: str) -> dict[str, Column]:
    """mae, rmse, mape (null if all actual values are 0) and r2 (of a constant series: 1 if met exactly, else 0)."""
    e = F.col(actual) - F.col(predicted)
    usable = F.col(predicted).isNotNull()
    rest = F.sum(F.when(usable, e * e))
    y = F.when(usable, F.col(actual))
    mean = F.avg(y)
    spread = F.sum(y * y) - F.count(y) * mean * mean
    flat = F.max(y) == F.min(y)
    return {
        "mae": F.avg(F.abs(e)), "rmse": F.sqrt(F.avg(e * e)), "mape": F.avg(F.when(F.col(actual) != 0, F.abs(e / F.nullif(F.col(actual), F.lit(0.0))))) * 100,
        "r2": F.when(flat, F.when(rest == 0, 1.0).otherwise(0.0)).otherwise(1 - F.try_divide(rest, spread)),
    }


def evaluate(folds: DataFrame, key: Sequence[str], models: Sequence[str]) -> DataFrame:
    """Errors of every model over the folds of a series, one column each."""
    return folds.groupBy(*key).agg(*[c.alias(f"{m}_{n}") for m in models for n, c in errors("actual", m).items()])


def best_baseline(evaluated: DataFrame, candidate: str = "candidate_mae", baselines: Sequence[str] = ("naive", "historical_avg", "seasonal_naive")) -> DataFrame:
    """Adds the least error of the baselines that there are, the difference and whether the candidate is strictly better."""
    known = [F.nanvl(F.col(f"{b}_mae"), F.lit(None).cast("double")) for b in baselines]
    best = evaluated.withColumn("best_baseline_mae", F.least(*known) if len(known) > 1 else known[0])
    return best.withColumn("mae_diff", F.col(candidate) - F.col("best_baseline_mae")).withColumn("beats_best_baseline", F.coalesce(F.col(candidate) < F.col("best_baseline_mae"), F.lit(False)))


def long_enough(series: DataFrame, key: Sequence[str], ordinal: str, least: int = LEAST_PERIODS) -> DataFrame:
    """Rows of the series with enough distinct periods."""
    kept = series.groupBy(*key).agg(F.countDistinct(ordinal).alias("__n")).where(F.col("__n") >= least).drop("__n")
    return series.join(kept, list(key), "left_semi")


MODEL = "struct<n: long, slope: double, base_0: double, base_1: double, error: double>"


def fit(ordinal: Column, value: Column, use: Column | None = None) -> Column:
    """An aggregate: the least-squares line of ``value`` over ``ordinal`` with a step between the two seasons, as a struct of
    n, slope, the value at ordinal 0 by season, and standard error; null without points.

    With under LEAST_PERIODS points, or those of one season only, the line alone; with one ordinal, the mean. All of it
    follows from sums, so a fit is one partial aggregation."""
    use = F.lit(True) if use is None else use
    t, y = ordinal.cast("double"), value.cast("double")
    whole = {"n": F.count(F.when(use & y.isNotNull(), 1)).cast("double")}
    of = [F.when(use & y.isNotNull() & (F.pmod(ordinal, F.lit(SEASON)) == s), 1) for s in range(SEASON)]
    zero = F.lit(0.0)
    total = lambda w, x: F.coalesce(F.sum(F.when(w == 1, x)), zero)
    sums = [{"n": F.count(w).cast("double"), "t": total(w, t), "y": total(w, y), "tt": total(w, t * t), "ty": total(w, t * y), "yy": total(w, y * y)} for w in of]
    both = {k: sums[0][k] + sums[1][k] for k in sums[0]}
    split = (whole["n"] >= LEAST_PERIODS) & (sums[0]["n"] > 0) & (sums[1]["n"] > 0)

    def inner(s: dict, a: str, b: str, ab: str) -> Column:
        return s[ab] - F.try_divide(s[a] * s[b], s["n"])

    def within(a: str, b: str, ab: str) -> Column:
        parts = [F.coalesce(inner(s, a, b, ab), zero) for s in sums]
        return F.when(split, parts[0] + parts[1]).otherwise(inner(both, a, b, ab))

    slope = F.coalesce(F.try_divide(within("t", "y", "ty"), F.when(within("t", "t", "tt") > 1e-9, within("t", "t", "tt"))), zero)
    base = [F.when(split, F.try_divide(s["y"] - slope * s["t"], s["n"])).otherwise(F.try_divide(both["y"] - slope * both["t"], both["n"])) for s in sums]
    rest = F.greatest(within("y", "y", "yy") - slope * within("t", "y", "ty"), zero)
    free = F.greatest(whole["n"] - F.when(whole["n"] >= LEAST_PERIODS, 3).when(whole["n"] > 1, 2).otherwise(1), F.lit(1.0))
    made = F.struct(whole["n"].cast("long").alias("n"), slope.alias("slope"), base[0].alias("base_0"), base[1].alias("base_1"), F.sqrt(rest / free).alias("error"))
    return F.when(whole["n"] > 0, made).cast(MODEL)


def predict(model: Column, ordinal: Column) -> Column:
    """A fitted model's value at an ordinal."""
    base = F.when(F.pmod(ordinal, F.lit(SEASON)) == 0, model["base_0"]).otherwise(model["base_1"])
    return base + model["slope"] * ordinal


def fitted_folds(series: DataFrame, key: Sequence[str], ordinal: str, value: str, last: int | None = None, folds: int = FOLDS) -> DataFrame:
    """(key, test_ordinal, candidate): predictions of the fitted model, trained before each test point that the series has;
    ``last`` is the table's last ordinal, as it is without it."""
    earlier = F.col(ordinal) < F.col("test_ordinal")
    known = series if last is None else series.where(F.col(ordinal) <= last)
    fitted = _at_points(known, ordinal, folds).groupBy(*key, "test_ordinal").agg(fit(F.col(ordinal), F.col(value), earlier).alias("m"), F.max(~earlier).alias("has"))
    return fitted.where("has AND m IS NOT NULL").select(*key, "test_ordinal", predict(F.col("m"), F.col("test_ordinal")).alias("candidate"))


def fit_models(series: DataFrame, key: Sequence[str], ordinal: str, value: str) -> DataFrame:
    """(key, model, last_ordinal): the fitted model of each series."""
    return series.groupBy(*key).agg(fit(F.col(ordinal), F.col(value)).alias("model"), F.max(ordinal).cast("int").alias("last_ordinal"))


def forecast_from(models: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, target_ordinal, yhat, lower, upper) for the period after each model's last, none below 0; no refit."""
    target = (F.col("last_ordinal") + 1).cast("int")
    value = lambda s: F.greatest(F.lit(0.0), predict(F.col("model"), target) + s * BAND * F.col("model.error"))
    return models.select(*key, target.alias("target_ordinal"), value(0).alias("yhat"), value(-1).alias("lower"), value(1).alias("upper"))


def forecast_next(series: DataFrame, key: Sequence[str], ordinal: str, value: str) -> DataFrame:
    """The same straight from the series."""
    return forecast_from(fit_models(series, key, ordinal, value), key)


def series_problems(series: DataFrame, key: Sequence[str], ordinal: str, value: str) -> DataFrame:
    """(problem, rows): what breaks the contract of a series: unique non-null ordinals, numbers of at least 0."""
    twice = F.count("*").over(Window.partitionBy(*key, ordinal)) > 1
    y = F.col(value).cast("double")
    checks = {"null_ordinal": F.col(ordinal).isNull(), "repeated_ordinal": twice, "null_value": y.isNull() | F.isnan(y), "negative_value": y < 0}
    marked = series.select(*[c.alias(n) for n, c in checks.items()])
    sums = [F.struct(F.lit(n).alias("problem"), F.count(F.when(F.col(n), 1)).alias("rows")) for n in checks]
    return marked.agg(F.array(*sums).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def retrain_gate(current: DataFrame, trained: DataFrame, key: Sequence[str]) -> DataFrame:
    """Adds last_trained, retrain and reason to (key, current_max): a series is trained again only for a new period."""
    met = current.join(trained.select(*key, "last_trained"), list(key), "left")
    now, then = F.col("current_max"), F.col("last_trained")
    reason = F.when(then.isNull(), "bootstrap").when(now > then, "new_period").when(now < then, "regressed").otherwise("unchanged")
    return met.withColumn("reason", reason).withColumn("retrain", F.col("reason").isin("bootstrap", "new_period"))


def promotion(candidates: DataFrame, champions: DataFrame, key: Sequence[str]) -> DataFrame:
    """Adds champion_mae, promote and reason to candidates (mae, best_baseline_mae): a candidate must beat the baseline
    strictly and not be worse than the champion; a tie promotes."""
    met = candidates.join(champions.select(*key, F.col("mae").alias("champion_mae")), list(key), "left")
    beats = F.coalesce(F.col("mae") < F.col("best_baseline_mae"), F.lit(False))
    reason = F.when(~beats, "baseline").when(F.col("mae") > F.col("champion_mae"), "champion").when(F.col("champion_mae").isNull(), "bootstrap").otherwise("improves")
    return met.withColumn("reason", reason).withColumn("promote", F.col("reason").isin("bootstrap", "improves"))


def newest(registry: DataFrame, key: Sequence[str]) -> DataFrame:
    """The latest entry of each series, by time and version."""
    return latest_per_key(registry, key, [F.desc("trained_at"), F.desc("model_version")])


def champions(registry: DataFrame, key: Sequence[str]) -> DataFrame:
    return newest(registry.where("is_champion"), key)


def record(registry: DataFrame, promoted: DataFrame, key: Sequence[str]) -> DataFrame:
    """The registry with new entries; where a new champion comes in, the old one of its series is one no more."""
    fresh = promoted.where("is_champion").select(*key).distinct().withColumn("__new", F.lit(True))
    kept = registry.join(fresh, list(key), "left").withColumn("is_champion", F.col("is_champion") & F.col("__new").isNull()).drop("__new")
    return kept.select(*registry.columns).unionByName(promoted.select(*registry.columns))


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], written: str) -> DataFrame:
    """Old and new rows, the one written last for each key; of equal times the new one."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return latest_per_key(both, key, [F.desc(written), F.desc("__new")]).drop("__new")
