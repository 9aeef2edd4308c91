"""Registered queries vs their DuckDB oracle SQL on sf0.001 (the driver uses sf0.01)."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
import pytest

from __spark_entry__ import entry
from sensortwin.plans.catalog import queries
from sensortwin.plans.oracle import oracle_sql

from twin_rows import SF_SMALL

TABLES = ("events", "supplier", "customer")
SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "timestamp_ntz": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN"}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return v.isoformat() if hasattr(v, "isoformat") else repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(queries()) == set(oracle_sql())


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.count() > 0 and "estimated_co2_kg" in df.columns


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    sdf = queries()[name](spark, SF_SMALL)
    cols = sorted(sdf.columns)
    srows = Counter(tuple(_norm(r[c]) for c in cols) for r in sdf.collect())
    rel = duck.sql(oracle_sql()[name])
    assert list(rel.columns) == sdf.columns  # same names in the same order
    assert [SPARK_TO_DUCK.get(f.dataType.simpleString()) for f in sdf.schema.fields] == [str(t) for t in rel.types]
    idx = [rel.columns.index(c) for c in cols]
    drows = Counter(tuple(_norm(r[i]) for i in idx) for r in rel.fetchall())
    assert srows == drows
