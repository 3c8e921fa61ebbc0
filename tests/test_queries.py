"""Every registered query that has a SQL twin gives the same rows; the others run."""

import pytest
from oracle import of_duckdb, of_spark

from lodestream.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, name):
    got = of_spark(registry.QUERIES[name](spark, sf))
    if name in registry.SQL:
        assert got == of_duckdb(registry.SQL[name], sf)
    else:
        assert got[0]


def test_entry_module():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(registry.QUERIES) <= set(e.queries())
