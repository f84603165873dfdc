"""Every registered query with SQL gives the rows that DuckDB gives."""

import pytest
from conftest import DATA, same_rows

from tessera.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows(spark, duck, name):
    assert same_rows(QUERIES[name](spark, DATA), duck, SQL[name])


def test_entry(spark):
    assert registry.entry(spark, DATA).count() > 0
