"""A training corpus in five stages over ``documents``.

Toxic rows go; repeated lines go; one document of each near-duplicate group stays;
documents that hold benchmark passages go; what is left is encoded and decoded. Each
stage's result is written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlight.llm import bytebpe, decontaminate, linededup, neardup, toxicity
from ledgerlight.llm.common import read, stored


def toxic_rows_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, read(spark, sf_dir, "labels"))


def repeated_lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.rewrite(docs)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def contaminated_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bytebpe.digests(docs)


STAGES = [
    ("toxicity", toxic_rows_out),
    ("line_dedup", repeated_lines_out),
    ("minhash_near_dedup", near_duplicates_out),
    ("decontamination", contaminated_out),
    ("byte_bpe", encoded),
]

#: A trained classifier and MinHash have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
