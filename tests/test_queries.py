"""Every query against its SQL, value by value, on the smallest tables."""

import pytest

from evidentia import registry
from tests.compare import compare, connection


@pytest.fixture(scope="module")
def tables(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, tables, sf, name):
    rows, difference = compare(spark, tables, registry.QUERIES[name], registry.SQL[name], sf)
    assert not difference
    assert rows > 0


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    got = entry.entry(spark)
    assert got.columns == ["query_id", "status", "text", "cited_doc", "quote", "confidence"]
    assert set(registry.SQL) <= set(entry.oracle_sql()) and set(registry.QUERIES) <= set(entry.queries())
