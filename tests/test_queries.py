"""Every registered query runs, and equals its SQL where it has one."""

import pytest
from conftest import SMALL

from quillspark.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, same):
    same(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(name, spark):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    out = entry.entry(spark)
    assert out.columns == ["document_id", "similarity", "match"] and out.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
