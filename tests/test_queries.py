import math
import pathlib

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


def test_every_check_has_a_query():
    queries, checks = entry.queries(), entry.oracle_sql()
    assert set(checks) <= set(queries)
    assert len(queries) > 190


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["year", "has_feature", "num_samples", "num_positive", "rate"]
    assert df.count() > 0


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(float(value), 6) if isinstance(value, (int, float)) else str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", ["flagship_yearly_rate", "c12_person_cohort", "m13_eval_predictions", "h08_permutation_test_models"])
def test_query_equals_its_check(spark, name):
    db = duckdb.connect()
    for path in pathlib.Path(FOLDER).glob("*.parquet"):
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = entry.queries()[name](spark, FOLDER)
    want = db.sql(entry.oracle_sql()[name])
    assert _rows(df.columns, df.collect()) == _rows(want.columns, want.fetchall())


def test_missing_optional_modules_are_left_out_and_other_faults_show():
    assert entry._optional("no_such_corpus_module") is None
    assert entry._optional("tidemark.no_such_package.queries") is None
