"""Landing as a stream: new files are taken once, late corrections replace earlier rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from medlar.operators.dedupe import last_write_wins


def arrivals(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def first_of_copies(stream: DataFrame, key: Sequence[str], at: str, delay: str = "30 days") -> DataFrame:
    """Drops rows whose key was seen within the delay; state older than that is let go."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(key))


def windowed_counts(stream: DataFrame, at: str, group: Sequence[str], length: str, delay: str) -> DataFrame:
    """(window_start, group, n) of tumbling windows, closed once the watermark has passed them."""
    counted = stream.withWatermark(at, delay).groupBy(F.window(at, length), *group).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), *group, "n")


def land_latest(stream: DataFrame, root: str, checkpoint: str, key: Sequence[str], written: str) -> StreamingQuery:
    """Keeps, below ``root``, one version of a table per batch with the last-written row of each key; takes what has
    arrived and stops. A batch that runs again writes the same version again."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = batch.limit(0) if number == 0 else spark.read.parquet(f"{root}/version={number - 1}")
        last_write_wins(before.unionByName(batch), key, written).write.mode("overwrite").parquet(f"{root}/version={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Takes what has arrived, appends it and stops."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
