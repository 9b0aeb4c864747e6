"""The operators' queries over the synthetic tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonegrid.llm import ann, bpe_chunks, langid, line_dedup, mixing, outliers, quality, simhash, token_counts, toxicity
from zonegrid.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Half as many tokens again as there are, nearly evenly from all sources, each used twice at most, in blocks of 20,000 tokens.
MIXTURE = mixing.Target(entropy=0.999, repeats=2.0, share=1.5, block=20_000)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = mixing.mixture(table(spark, sf_dir, "documents"), MIXTURE)
    return own.withColumn("weight", F.round("weight", 9))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judge(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_chunks.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_mixing": op2_mixing,
        "op3_token_counts": op3_token_counts,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_nearest_neighbours": op5_nearest_neighbours,
        "op6_quality_rules": op6_quality_rules,
        "op7_line_dedup": op7_line_dedup,
        "op8_language_id": op8_language_id,
        "op9_bpe": op9_bpe,
        "op10_simhash_near_dedup": op10_simhash_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mixing": mixing.sql(MIXTURE),
        "op7_line_dedup": line_dedup.SQL,
    }
