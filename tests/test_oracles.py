"""Every registered query with SQL against DuckDB at the smallest scale."""

from __future__ import annotations

import duckdb
import pytest

import verify
from touchline.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    db = duckdb.connect()
    for t in verify.TABLES:
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    said = db.sql(registry.ORACLES[name])
    assert verify.rows_of(df.columns, [tuple(r) for r in df.collect()]) == verify.rows_of(said.columns, said.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    registry.QUERIES[name](spark, SF).collect()
