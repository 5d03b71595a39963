"""Every registered query against its SQL counterpart, over the smallest given tables."""

from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from registry.oracle import ORACLE
from registry.queries import QUERIES

from .compare import connect, duck_rows, spark_rows

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    with connect(SF_DIR) as con:
        yield con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(ORACLE) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, duck, name):
    columns, rows = spark_rows(queries()[name](spark, SF_DIR))
    expected_columns, expected = duck_rows(duck, oracle_sql()[name])
    assert columns == expected_columns
    assert rows == expected


def test_entry(spark):
    assert entry(spark).count() > 0
