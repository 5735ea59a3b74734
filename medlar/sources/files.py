"""Paths, scans and sinks over any file system that Spark reaches."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors see: below spark.checkpoint.dir, or in local mode a temporary one."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="medlar-")
    return f"{folder}/scratch-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, where = _fs(spark, old)
    target = spark._jvm.org.apache.hadoop.fs.Path(new)
    fs.mkdirs(target.getParent())
    if not fs.rename(where, target):
        raise OSError(f"can't move {old} to {new}")


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified) of the files below a folder, without reading their content."""
    if not exists(spark, root):
        return spark.createDataFrame([], "path string, length long, modified timestamp")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def fingerprints(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, sha256) of small files such as configurations."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def strings(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str) -> DataFrame | None:
    """A CSV file with a header, all columns as text under stripped lower-case names; None if it isn't there."""
    if not exists(spark, path):
        return None
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return df.toDF(*[c.strip().lower() for c in df.columns])


def read_csv_tree(spark: SparkSession, root: str, name: str, columns: Sequence[str]) -> DataFrame:
    """All files of a name anywhere below a folder, as text."""
    return spark.read.schema(strings(columns)).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).csv(root)


def read_all_partitions(spark: SparkSession, root: str) -> DataFrame:
    """Every partition and batch of an entity."""
    if not exists(spark, root):
        raise FileNotFoundError(root)
    return spark.read.option("mergeSchema", True).parquet(root)


def replace(df: DataFrame, path: str, must_exist: bool = False) -> None:
    """Overwrite a table, also one that ``df`` reads: written beside it first, then moved into its place. With
    ``must_exist`` a table that isn't there is an error. Rows are counted while they are written."""
    spark = df.sparkSession
    if must_exist and not exists(spark, path):
        raise FileNotFoundError(path)
    staged, written = f"{path}.staged-{uuid.uuid4().hex}", Observation()
    df.observe(written, F.count(F.lit(1)).alias("n")).write.parquet(staged)
    if spark.read.parquet(staged).count() != written.get["n"]:
        raise OSError(f"{staged} does not have all rows")
    old = f"{path}.old-{uuid.uuid4().hex}"
    if exists(spark, path):
        rename(spark, path, old)
    rename(spark, staged, path)
    delete(spark, old)


def write_quarantine(df: DataFrame, path: str) -> bool:
    """Write rejected rows if there are any."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").parquet(path)
    return True


class ConstraintError(ValueError):
    """A set of tables breaks what it promises."""


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], version: str, constraints: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] | None = None) -> None:
    """Write a set of tables that belong together as one version; readers see it when a pointer names it.

    Columns that start with an underscore stay out. ``constraints`` give, from the tables as written, the rows that break
    them: if any has rows, nothing is pointed to. Pointers are numbered, a new one appears by one rename, and the last
    one counts: at no time is there none."""
    for name, df in tables.items():
        df.select([c for c in df.columns if not c.startswith("_")]).write.parquet(f"{root}/versions/{version}/{name}")
    written = {name: spark.read.parquet(f"{root}/versions/{version}/{name}") for name in tables}
    broken = [name for name, check in (constraints or {}).items() if not check(written).isEmpty()]
    if broken:
        raise ConstraintError(f"version {version}: {', '.join(sorted(broken))}")
    staged = f"{root}/staged-{uuid.uuid4().hex}"
    spark.createDataFrame([(version,)], "value string").coalesce(1).write.text(staged)
    rename(spark, staged, f"{root}/pointers/{len(pointers(spark, root)):010}")


def pointers(spark: SparkSession, root: str) -> list[str]:
    """Paths of the pointers, the last one counts."""
    fs, where = _fs(spark, f"{root}/pointers")
    return sorted(str(f.getPath()) for f in fs.listStatus(where)) if fs.exists(where) else []


def current_version(spark: SparkSession, root: str) -> str:
    found = pointers(spark, root)
    if not found:
        raise FileNotFoundError(f"{root}: nothing is published")
    return spark.read.text(found[-1]).first()[0]


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/versions/{current_version(spark, root)}/{name}")


def sql_scan(spark: SparkSession, statement: str, **tables: DataFrame) -> DataFrame:
    """A statement over tables that are registered under the given names while it is analysed."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    found = spark.sql(statement)
    for name in tables:
        spark.catalog.dropTempView(name)
    return found


def jdbc_scan(spark: SparkSession, url: str, statement: str, **options: str) -> DataFrame:
    """A statement that a database runs; its driver must be on the class path."""
    return spark.read.format("jdbc").options(url=url, query=statement, **options).load()


def save_table(df: DataFrame, name: str) -> None:
    """A table of the session's catalog, replaced as a whole; queries read it by name."""
    df.write.mode("overwrite").saveAsTable(name)


def write_partitioned_csv(df: DataFrame, path: str, by: Sequence[str]) -> None:
    df.write.partitionBy(*by).option("header", True).csv(path)


def reference_rows(spark: SparkSession, text: str, key: str, columns: Sequence[str], schema: str) -> DataFrame:
    """Rows of a list in a YAML or JSON document; unknown keys of an entry are an error."""
    try:
        import yaml

        entries = yaml.safe_load(text)[key]
    except ImportError:
        entries = json.loads(text)[key]
    extra = sorted({k for e in entries for k in e} - set(columns))
    if extra:
        raise ValueError(f"unknown keys: {extra}")
    return spark.createDataFrame([tuple(e.get(c) for c in columns) for e in entries], schema)


def write_csv_report(df: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header; n/a for what is missing."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "n/a").csv(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small report as a Markdown table; n/a for what is missing, a sign before differences."""
    rows = df.limit(most).collect()

    def show(name: str, value) -> str:
        if value is None or value != value:
            return "n/a"
        if isinstance(value, float):
            return f"{value:+.2f}" if name.endswith("_diff") else f"{value:.2f}"
        return str(value)

    lines = [df.columns, ["---"] * len(df.columns), *([show(c, r[c]) for c in df.columns] for r in rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines) + "\n"
