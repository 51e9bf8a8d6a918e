"""Queries with SQL give DuckDB's rows on the smallest tables."""

import pytest

from lagoon.llm.queries import oracle_sql, queries
from tests.compare import duck_rows, rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    df = queries()[name](spark, SF)
    assert rows(df) == duck_rows(SF, oracle_sql()[name], df.columns)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_runs(spark, name):
    assert queries()[name](spark, SF).count()
