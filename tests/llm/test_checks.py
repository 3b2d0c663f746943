"""Queries with an SQL twin against DuckDB; every query with an SQL twin is listed by its registration."""

import pathlib

import duckdb
import pytest

from tidemark.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for path in pathlib.Path(FOLDER).glob("*.parquet"):
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = db.sql(ORACLES[name])
    df = QUERIES[name](spark, FOLDER).select(*want.columns)
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want.fetchall()))
