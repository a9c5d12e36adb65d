"""Parquet table access for the given input tables.

Only ``spark.read.parquet``: column pruning and filter pushdown reach the scan
through Catalyst, so callers select what they need and nothing more is read.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_events(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """S1 (batch): captured call events with the fixed EVENT schema (no inference)."""
    from ternlens.schemas import EVENT_SCHEMA
    return spark.read.schema(EVENT_SCHEMA).format(fmt).load(path)
