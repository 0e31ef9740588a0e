"""The training-data pipeline: documents in, packed sequences out, one written table between any two stages.

Language ID drops documents without a letter (``und``) and no others where several languages are learnt, exact de-duplication and the Jaccard join leave one of each
group of equal and of similar texts, the suffix sort cuts repeated passages out of the rest, and packing places
what is left in sequences.  Rows, ties, nulls and empty tables are treated as the operators say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from signalmart.llm import exact_dedup, hd_language, jaccard_join, packing, suffix_dedup
from signalmart.sources.shared import stage


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return hd_language.keep_identified(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one_of_each(docs, words=5, percent=80)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.drop_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identified),
    ("exact_dedup", distinct),
    ("jaccard_join", dissimilar),
    ("suffix_dedup", without_repeats),
    ("best_fit_packing", packed),
]

# Prototypes, byte strings and packing are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(f"pipeline-{name}")(function(spark, docs, sf_dir))
    return docs
