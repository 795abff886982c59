"""Every registered query against DuckDB on the same tables."""

import pytest

import __spark_entry__ as entry
from __spark_entry__ import training_text
from oracle_check import compare, duck

QUERIES = entry.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


def test_every_query_of_the_core_has_sql():
    optional = set(training_text.queries()) | {"pipeline"} if training_text else set()
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) <= optional


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, folder, name):
    assert compare(spark, con, QUERIES[name], SQL[name], folder) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["category_id", "year_month", "revenue", "category_name"]
    assert df.count() > 0
