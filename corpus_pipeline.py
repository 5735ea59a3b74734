"""The training-data pipeline: documents in, a deduplicated, clean, mixed and shuffled corpus out.

Every stage works on all rows that the one before it kept; a stage's result is written as Parquet and read again before
the next. ``run`` puts these tables below the session's checkpoint folder and removes each once the next one is written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medlar.llm import decontamination, mixing, near_duplicates, sharding, toxicity
from medlar.llm.shared import free_name, prepare, table
from medlar.sources import files


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models, learned from all labels, do not call toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored, name = toxicity.with_score(docs, model)
    return scored.where(F.col(name) < 0.5).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_duplicates.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for: whole documents, those whose first word the mix takes."""
    name, again = free_name(docs, "mix"), free_name(docs, "__again")
    copies = F.col(f"{name}.copies")
    mixed = mixing.mix(docs, name=name).where(copies > 0)
    return mixed.withColumn(again, F.explode(F.sequence(F.lit(1).cast("long"), copies))).drop(name, again)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in random order in shards: columns shard and slot come on top, with underscores if there are such."""
    name, shard, slot = (free_name(docs, c) for c in ("place", "shard", "slot"))
    placed = sharding.shuffled_shards(docs, name=name)
    return placed.withColumn(shard, F.col(f"{name}.shard")).withColumn(slot, F.col(f"{name}.slot")).drop(name)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: Trained models, hashing and seeded orders: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, in their order."""
    prepare(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    written = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if written:  # what a stage has read isn't needed again
            files.delete(spark, written)
        written = f"{folder}/{name}"
    return docs
