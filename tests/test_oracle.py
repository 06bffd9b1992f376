"""Every registered query against its SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import connect, problems


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(name, spark, sf_dir, connection):
    result = entry.queries()[name](spark, sf_dir)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert result.count() > 0
    else:
        assert problems(result, connection, sql) == []


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["queue", "max_eid", "records", "chars"]
    assert result.count() == 5
