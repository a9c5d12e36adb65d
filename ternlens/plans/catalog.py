"""Registry of named queries: a Spark plan per name, plus its DuckDB oracle SQL.

Each query reads the given tables (through the bridge views) at whatever scale
``sf_dir`` holds, so its work grows with them. Computed doubles are rounded to
9 decimals on both sides, so last-bit differences of summation order between
engines do not decide the comparison; scores keep their own 4-decimal rounding.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ternlens.session import ship_package

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
DESCRIPTIONS: dict[str, str] = {}


def register(name: str, sql: str | None = None, ops: str = ""):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Event time is UTC throughout (the files carry zone-less timestamps).
            if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
                spark.conf.set("spark.sql.session.timeZone", "UTC")
            ship_package(spark)
            return fn(spark, sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        DESCRIPTIONS[name] = ops
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r9(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 9)


def load_all() -> None:
    # Importing the modules registers their queries.
    from ternlens.plans import (q_records, q_alerts, q_text, q_vectors, q_scoring,  # noqa: F401
                                q_regression, q_io, q_models)


def queries() -> dict[str, QueryFn]:
    load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load_all()
    return dict(ORACLE)
