"""Every registered query against its SQL twin, on the smallest tables."""

from __future__ import annotations

import compare
import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns, rows = compare.spark_result(df)
    assert len(set(columns)) == len(columns)
    if name in ORACLES:
        sql_columns, sql_rows = compare.sql_result(con, ORACLES[name])
        assert columns == sql_columns
        assert rows == sql_rows
        assert not compare.kind_mismatches(df, con, ORACLES[name])


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
