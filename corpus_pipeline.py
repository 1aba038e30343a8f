"""A training-data pipeline over ``documents``: five stages, each of them one operator.

All stages but the last give the columns of their input, whatever their names,
take texts of any length in whole and give an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import jaccard_join, language_id, pii, sentencepiece_codec, source_mix
from sparkloom.llm._shared import stored


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language (null, or no letter) go; repeated rows stay or go together."""
    return language_id.reject_unknown(docs, language_id.learn(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8; of repeated rows one."""
    return jaccard_join.drop_near_copies(docs, k=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets give way to surrogates; null texts stay, repeated rows change alike."""
    return pii.with_surrogates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources, null among them, come to their target weights; documents repeat as often as they are taken."""
    return source_mix.mixed(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, checked by decoding them; a row for each row."""
    return sentencepiece_codec.encode_documents(docs, sentencepiece_codec.load())


STAGES = [
    ("language_id", languages),
    ("ngram_jaccard_join", near_copies),
    ("pii_surrogates", personal_data),
    ("source_mix", mixture),
    ("sentencepiece", pieces),
]

#: Kernels, draws and piece merges have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else stored(docs), sf_dir)
    return docs
