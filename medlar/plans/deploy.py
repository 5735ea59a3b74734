"""Training and promotion of all series at once: gate, evaluate, decide, refit, record and forecast as joins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medlar.functions.periods import model_version
from medlar.plans import forecasting as fc

#: Baselines that a candidate for promotion must beat; reports also show the seasonal one.
PROMOTION_BASELINES = ("naive", "historical_avg")
REGISTRY = "model_version string, metric string, trained_at timestamp, mae double, best_baseline_mae double, is_champion boolean, promoted_at timestamp, trained_to int, params string"


@dataclass(frozen=True)
class Deployment:
    """Decisions of each series, the registry after it and the forecasts of promoted series."""

    decisions: DataFrame
    registry: DataFrame
    forecasts: DataFrame


def empty_registry(series: DataFrame, key: Sequence[str]) -> DataFrame:
    kinds = ", ".join(f"{k} {series.schema[k].dataType.simpleString()}" for k in key)
    return series.sparkSession.createDataFrame([], f"{kinds}, {REGISTRY}")


def deploy(series: DataFrame, registry: DataFrame, key: Sequence[str], ordinal: str, metric: str, baselines: Sequence[str] = PROMOTION_BASELINES) -> Deployment:
    """Series that have a new period are evaluated; a candidate that beats the baselines and is not worse than the champion
    takes its place and forecasts the next period. A table without rows deploys nothing."""
    key = list(key)
    known = registry.where(F.col("metric") == metric)
    last = series.agg(F.max(ordinal)).first()[0]
    current = series.groupBy(*key).agg(F.max(ordinal).alias("current_max"))
    gated = fc.retrain_gate(current, fc.newest(known, key).select(*key, F.col("trained_to").alias("last_trained")), key).withColumnRenamed("reason", "gate")
    due = series.join(gated.where("retrain").select(*key), key, "left_semi")
    due = fc.long_enough(due, key, ordinal)
    folds = fc.baselines(due, key, ordinal, metric) if last is not None else None
    if folds is None:
        none = registry.limit(0)
        return Deployment(gated, registry, none.select(*key).withColumns({c: F.lit(None).cast("double") for c in ("yhat", "lower", "upper")}))
    folds = folds.join(fc.fitted_folds(due, key, ordinal, metric, int(last)), [*key, "test_ordinal"], "left")
    judged = fc.best_baseline(fc.evaluate(folds, key, ["candidate", *baselines]), baselines=baselines)
    decided = fc.promotion(judged.withColumnRenamed("candidate_mae", "mae").select(*key, "mae", "best_baseline_mae", "mae_diff"), fc.champions(known, key), key)
    now = F.current_timestamp()
    models = fc.fit_models(due, key, ordinal, metric)
    params = F.to_json(F.struct(F.lit("line").alias("kind"), F.col("last_ordinal").alias("to"), "model"))
    fresh = decided.join(current, key).join(models, key).select(
        *key, model_version(F.concat_ws("-", *key), F.lit(metric), now).alias("model_version"), F.lit(metric).alias("metric"), now.alias("trained_at"), "mae", "best_baseline_mae",
        F.col("promote").alias("is_champion"), F.when(F.col("promote"), now).alias("promoted_at"), F.col("current_max").alias("trained_to"), params.alias("params"),
    )
    others = registry.where(F.col("metric") != metric)
    after = others.unionByName(fc.record(known, fresh, key))
    forecasts = champion_forecasts(fresh, key)
    return Deployment(gated.join(decided, key, "left"), after, forecasts)


def load(registry: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, model_version, metric, model, last_ordinal) of the champions, as they were stored."""
    stored = F.from_json("params", f"struct<kind: string, to: int, model: {fc.MODEL}>")
    champions = fc.champions(registry, [*key, "metric"]).withColumn("__stored", stored)
    return champions.select(*key, "model_version", "metric", F.col("__stored.model").alias("model"), F.col("__stored.to").alias("last_ordinal"))


def champion_forecasts(registry: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, target_ordinal, yhat, lower, upper, model_version, metric) of the champions, from their stored coefficients."""
    key = list(key)
    models = load(registry, key)
    made = fc.forecast_from(models, [*key, "metric"])
    return made.join(models.select(*key, "metric", "model_version"), [*key, "metric"]).select(*key, "target_ordinal", "yhat", "lower", "upper", "model_version", "metric")


def report(decisions: DataFrame, key: Sequence[str]) -> DataFrame:
    """What a reader of an evaluation wants to see, series by series."""
    return decisions.select(*key, "gate", "mae", "best_baseline_mae", "mae_diff", "promote", "reason").orderBy(*key)
