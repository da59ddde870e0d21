"""Registered queries of the operators and the pipeline, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlight.llm import bytebpe, decontaminate, linededup, merkle, neardup, quality, repair, sharding, substrings, tokenfile, toxicity, urlfilter, wrapper
from ledgerlight.llm.common import read


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_files(read(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(read(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(read(spark, sf_dir, "pages"), urlfilter.listed_frame(spark))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.digests(read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(read(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(read(spark, sf_dir, "documents"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(read(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(read(spark, sf_dir, "conversations"))


OPERATORS = (
    op1_token_files, op2_decontaminate, op3_quality, op4_line_dedup, op5_near_dedup, op6_url_filter, op7_sharding, op8_byte_bpe, op9_toxicity, op10_html_text,
    op11_merkle_manifest, op12_substring_dedup, op13_conversation_repair,
)


def queries() -> dict:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict:
    return {"op6_url_filter": urlfilter.sql(), "op12_substring_dedup": substrings.sql()}
