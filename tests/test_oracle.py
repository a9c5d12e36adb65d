"""Every registered query against its DuckDB oracle on the smallest scale factor."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from ternlens.plans import catalog
from ternlens.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
QUERIES = catalog.queries()
ORACLE = catalog.oracle_sql()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return _norm(tuple(v.asDict().items()))
    if hasattr(v, "isoformat"):
        try:
            return v.isoformat(sep=" ")
        except TypeError:
            return v.isoformat()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_oracle_or_is_documented():
    missing = set(QUERIES) - set(ORACLE)
    assert missing <= {"toxicity_model_scores", "embedding_principal_points"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    srows, scols = df.collect(), df.columns
    res = con.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    assert sorted(scols) == sorted(dcols)
    assert _rows(scols, srows) == _rows(dcols, res.fetchall())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "aggregate_health" in df.columns
