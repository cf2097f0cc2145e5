"""Every query that has SQL, against DuckDB on the same tables."""

from __future__ import annotations

import pytest

from lodestone.plans import catalogue

from .compare import check, connect


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, con, name):
    check(spark, con, name, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)
