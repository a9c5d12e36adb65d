"""Golden datasets and regression reports as JSON.

A golden dataset is a folder of JSON documents, each with the header (name, version,
description) and some of the examples with their positions; a single document with all examples, as a
user writes it by hand, is the same format.  Reading ``posexplode``s the examples into rows and
fills defaults.  Writing splits the examples by position into documents of ``DOCUMENT_EXAMPLES``, so no
document, and no task, holds more, whatever the dataset's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ternlens import constants as K
from ternlens.schemas import GOLDEN_SCHEMA

DOCUMENT_EXAMPLES = 10_000


def load_golden(spark: SparkSession, path: str) -> DataFrame:
    """S3: one row per example with defaults; a missing path raises (PATH_NOT_FOUND)."""
    doc = spark.read.option("multiLine", True).schema(GOLDEN_SCHEMA).json(path)
    ex = doc.select(F.coalesce("name", F.lit("default")).alias("dataset_name"),
                    F.coalesce("version", F.lit("1.0")).alias("version"),
                    F.posexplode_outer("examples").alias("position", "e"))
    e = F.col("e")
    return ex.where(e.isNotNull()).select(
        "dataset_name", "version", F.coalesce(e["position"], F.col("position")).cast("int").alias("position"),
        e["query"].alias("query"),
        F.coalesce(e["expected_response"], F.lit("")).alias("expected_response"),
        e["context"].alias("context"),
        F.coalesce(e["tags"], F.array().cast("array<string>")).alias("tags"),
        F.coalesce(e["max_hallucination"], F.lit(K.GOLDEN_MAX_HALLUCINATION)).alias("max_hallucination"),
        e["min_faithfulness"].alias("min_faithfulness"),
        e["expected_language"].alias("expected_language"),
        F.coalesce(e["max_toxicity"], F.lit(K.GOLDEN_MAX_TOXICITY)).alias("max_toxicity"),
    )


def save_golden(examples: DataFrame, path: str, name: str = "default", version: str = "1.0",
                description: str = "") -> None:
    """Write examples with their ``position`` as golden JSON documents under ``path``."""
    cols = ["query", "expected_response", "context", "tags", "max_hallucination", "min_faithfulness",
            "expected_language", "max_toxicity"]
    part = F.floor(F.col("position") / DOCUMENT_EXAMPLES)
    doc = (examples.groupBy(part.alias("_part"))
           .agg(F.sort_array(F.collect_list(F.struct("position", *cols))).alias("examples"))  # DOCUMENT_EXAMPLES at most
           .select(F.lit(name).alias("name"), F.lit(version).alias("version"), F.lit(description).alias("description"),
                   "examples"))
    doc.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def save_regression_report(summary: DataFrame, failures: DataFrame, path: str) -> None:
    """The suite summary and its failures table as JSON under ``path``."""
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    failures.write.mode("overwrite").json(f"{path}/failures")


def load_regression_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(summary, failures) as ``save_regression_report`` wrote them; both may be empty."""
    summary = ("dataset_name string, total long, passed long, failed long, pass_rate double, gate_passed boolean")
    failures = "item_id long, query string, expected_response string, actual_response string, violations array<string>"
    return spark.read.schema(summary).json(f"{path}/summary"), spark.read.schema(failures).json(f"{path}/failures")
