"""Every library query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from compare import assert_same, connection

from needledrop.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connection(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    assert_same(QUERIES[name](spark, sf_dir), duck, SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
