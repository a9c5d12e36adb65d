"""A training corpus from raw documents: five stages, each one operator of ``ternlens.llm``.

Every stage but the last returns the columns of ``documents``.  ``run`` writes each stage's result as
Parquet into the shared checkpoint folder and reads it again, so no stage is computed twice and a lost
executor costs only its own tasks.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ternlens.llm import exact_dedup, langid, near_dedup, packing, suffix_dedup
from ternlens.llm.common import staged
from ternlens.llm.queries import vocabulary_path
from ternlens.session import ship_package


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the character models accept."""
    ship_package(spark)
    return langid.keep_identified(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, one document."""
    return exact_dedup.keep_rows(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, one document."""
    ship_package(spark)
    return near_dedup.keep_rows(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that occur more than once."""
    ship_package(spark)
    return suffix_dedup.without_repeats(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    ship_package(spark)
    return packing.pack(docs, vocabulary_path())


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("suffix_dedup", repeated_strings),
    ("packing", packed_sequences),
]

#: SQL can't express the models, signatures and tokens of these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
