"""The training-data operators as registered queries, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medlar.llm import mixing, near_duplicates
from medlar.llm.decontamination import decontamination_matches
from medlar.llm.importance import importance_sample
from medlar.llm.language import language_report
from medlar.llm.lm_scoring import lm_scores
from medlar.llm.nearest import nearest_by_inner_product
from medlar.llm.shared import table
from medlar.llm.sharding import shuffled_shards, text_size
from medlar.llm.token_counts import token_report
from medlar.llm.toxicity import toxicity_scores


def op1_decontamination_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_near_duplicates_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op3_toxicity_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_counts_two_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_report(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")), public_tokenizers.PATTERN)


def op6_language_conditional_random_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "documents"))


def op7_sharding_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shuffled_shards(table(spark, sf_dir, "documents"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")))
    return placed.select("doc_id", text_size(F.col("text")).alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "place.shard", "place.slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_nearest_neighbours_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_by_inner_product(table(spark, sf_dir, "embeddings"))


def op9_mixing_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", *[F.col(f"mix.{c}").alias(c) for c in ("size", "source_size", "target", "taken")])


def op10_lm_scoring_gated_recurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_decontamination_templates,
        op2_near_duplicates_probminhash,
        op3_toxicity_kneser_ney,
        op4_quality_importance_resampling,
        op5_token_counts_two_tier,
        op6_language_conditional_random_field,
        op7_sharding_two_pass_shuffle,
        op8_nearest_neighbours_hnsw,
        op9_mixing_sainte_lague,
        op10_lm_scoring_gated_recurrent,
        pipeline,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op2_near_duplicates_probminhash": near_duplicates.ORACLE, "op9_mixing_sainte_lague": mixing.ORACLE}
