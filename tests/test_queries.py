"""Every query with SQL gives DuckDB's rows on the smallest tables; the others run."""

import pytest

from lagoon.plans import catalogue
from tests.compare import duck_rows, rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, name):
    df = catalogue.queries()[name](spark, SF)
    sql = catalogue.oracle_sql().get(name)
    got = rows(df)
    if sql is None:
        assert got
    else:
        assert got == duck_rows(SF, sql, df.columns)


def test_every_sql_has_a_query():
    assert not set(catalogue.oracle_sql()) - set(catalogue.queries())
