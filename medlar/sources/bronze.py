"""Raw landing: append-only batches, a run log that makes ingestion idempotent, and an audit of both."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medlar.sources import files

LOG = "stage string, entity string, partition_key string, status string, batch_id string, rows long, message string, started_at timestamp, completed_at timestamp"
AUDIT_COLUMNS = ("_ingested_at", "_source_file", "_batch_id")

# Kinds of failure in the run log.
CATEGORIES = (
    "INVALID_SCHEMA", "INVALID_ACADEMIC_YEAR", "INVALID_SEMESTER", "INVALID_YEAR_LEVEL", "DUPLICATE_DATA", "DATA_QUALITY_FAILURE", "STORAGE_ERROR",
    "ENGINE_ERROR", "DATABASE_ERROR", "MART_ERROR", "FEATURE_ENGINEERING_ERROR", "MODEL_TRAINING_ERROR", "MODEL_EVALUATION_ERROR", "FORECAST_ERROR",
)


class PipelineError(ValueError):
    """A failure whose kind is known."""

    def __init__(self, message: str, category: str):
        if category not in CATEGORIES:
            raise KeyError(category)
        super().__init__(message)
        self.category = category


class IngestionError(PipelineError):
    """A source can't be landed."""

    def __init__(self, message: str, category: str = "INVALID_SCHEMA"):
        super().__init__(message, category)


def stamp(df: DataFrame, source: str, batch_id: str) -> DataFrame:
    """Adds when, from where and in which batch a row was landed."""
    return df.withColumns({"_ingested_at": F.current_timestamp(), "_source_file": F.lit(source), "_batch_id": F.lit(batch_id)})


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise IngestionError(f"missing columns: {missing}")
    if df.isEmpty():
        raise IngestionError("no rows")
    return df


def inspect(df: DataFrame) -> dict:
    return {"columns": df.columns, "types": dict(df.dtypes), "rows": df.count()}


def category(error: BaseException) -> str:
    """The kind of failure: its own, or by the error's type and the module that it comes from."""
    if isinstance(error, PipelineError):
        return error.category
    if isinstance(error, OSError):
        return "STORAGE_ERROR"
    if isinstance(error, KeyError):
        return "INVALID_SCHEMA"
    module = type(error).__module__.split(".")[0]
    return {"pyspark": "ENGINE_ERROR", "py4j": "ENGINE_ERROR", "sqlite3": "DATABASE_ERROR"}.get(module, "DATA_QUALITY_FAILURE")


class RunLog:
    """An append-only table of runs."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        if not files.exists(self.spark, self.path):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(self.path)

    def append(self, stage: str, entity: str, partition: str, status: str, batch_id: str | None = None, rows: int | None = None, message: str | None = None, started: datetime | None = None) -> None:
        """A running stage has no time of completion."""
        now = datetime.now(timezone.utc)
        row = (stage, entity, partition, status, batch_id, rows, message, started or now, None if status == "RUNNING" else now)
        self.spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(self.path)

    def append_once(self, stage: str, entity: str, partition: str, **values) -> bool:
        """Append a success unless the unit has one; every batch of a unit that is forced again is logged by ``append``."""
        known = self.succeeded().where((F.col("stage") == stage) & (F.col("entity") == entity) & (F.col("partition_key") == partition))
        if not known.isEmpty():
            return False
        self.append(stage, entity, partition, "SUCCESS", **values)
        return True

    def succeeded(self) -> DataFrame:
        return self.read().where("status = 'SUCCESS'").select("stage", "entity", "partition_key", "batch_id").distinct()

    def tally(self) -> DataFrame:
        return self.read().groupBy("status").agg(F.count("*").alias("n"))

    def tracked(self, stage: str, entity: str, run: Callable[[], int]) -> int:
        """Run a stage with its rows of the log; errors are logged with their kind and raised again."""
        started = datetime.now(timezone.utc)
        self.append(stage, entity, "", "RUNNING", started=started)
        try:
            rows = run()
        except Exception as error:
            self.append(stage, entity, "", "FAILED", message=f"{category(error)}: {error}", started=started)
            raise
        self.append(stage, entity, "", "SUCCESS", rows=rows, started=started)
        return rows


def unit_states(wanted: DataFrame, succeeded: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds state to units (entity, partition_key): DONE if logged and stored, DRIFT if logged only, else NEW."""
    key = ["entity", "partition_key"]
    logged = succeeded.select(*key).distinct().withColumn("__logged", F.lit(True))
    there = stored.select(*key).distinct().withColumn("__stored", F.lit(True))
    met = wanted.join(logged, key, "left").join(there, key, "left")
    state = F.when(F.col("__logged").isNull(), "NEW").when(F.col("__stored").isNull(), "DRIFT").otherwise("DONE")
    return met.withColumn("state", state).drop("__logged", "__stored")


def unit_path(root: str, entity: str, partition: str) -> str:
    return f"{root}/{entity}/partition_key={partition}"


def ingest(log: RunLog, root: str, entity: str, partition: str, load: Callable[[], DataFrame | None], columns: Sequence[str], source: str = "", force: bool = False) -> dict:
    """Land one unit: skipped if it is logged and stored; landed again, with a line in the log, if it is logged only. A
    failure becomes a line in the log and a status, not an exception."""
    spark, stage = log.spark, "bronze"
    path = unit_path(root, entity, partition)
    done = not log.succeeded().where((F.col("entity") == entity) & (F.col("partition_key") == partition)).isEmpty()
    stored = files.exists(spark, path)
    if done and stored and not force:
        return {"status": "SKIPPED", "rows": 0}
    if done and not stored:
        log.append(stage, entity, partition, "DRIFT_DETECTED")
    batch, started = uuid.uuid4().hex, datetime.now(timezone.utc)
    try:
        df = load()
        if df is None:
            return {"status": "NO_SOURCE_FILE", "rows": 0}
        df = require(df.toDF(*[c.strip().lower() for c in df.columns]), columns)
        stamp(df, source, batch).write.parquet(f"{path}/batch_id={batch}")
        rows = spark.read.parquet(f"{path}/batch_id={batch}").count()
    except Exception as error:  # noqa: BLE001
        log.append(stage, entity, partition, "FAILED", batch, message=f"{category(error)}: {error}", started=started)
        return {"status": "FAILED", "rows": 0, "message": str(error)}
    log.append(stage, entity, partition, "SUCCESS", batch, rows, started=started)
    return {"status": "SUCCESS", "rows": rows}


def audit(logged: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds status to logged batches (entity, partition_key, batch_id): OK, EMPTY_OBJECT or MISSING_OBJECT by what is stored
    (the same columns and length)."""
    key = ["entity", "partition_key", "batch_id"]
    sizes = stored.groupBy(*key).agg(F.sum("length").alias("__length"))
    met = logged.join(sizes, key, "left")
    status = F.when(F.col("__length").isNull(), "MISSING_OBJECT").when(F.col("__length") == 0, "EMPTY_OBJECT").otherwise("OK")
    return met.withColumn("audit_status", status).drop("__length")


def stored_batches(spark: SparkSession, root: str) -> DataFrame:
    """(entity, partition_key, batch_id, length) of the data files below the landing folder."""
    found = files.listing(spark, root, "*.parquet")
    part = lambda pattern: F.regexp_extract("path", pattern, 1)
    return found.select(part(r"/([^/]+)/partition_key=").alias("entity"), part(r"partition_key=([^/]+)").alias("partition_key"), part(r"batch_id=([^/]+)").alias("batch_id"), "length")
