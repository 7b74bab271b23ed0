"""Every query against its SQL on DuckDB."""

import pytest

import __spark_entry__ as spark_entry
from compare import connect, differences
from seqstates.catalog import oracle
from seqstates.catalog import queries as catalog

ORACLE = oracle.oracle_sql()
QUERIES = catalog.queries()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(spark_entry.queries())
    assert set(ORACLE) <= set(spark_entry.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, duck, name):
    assert differences(QUERIES[name](spark, sf_dir), duck, ORACLE[name]) is None


def test_entry(spark):
    rows = spark_entry.entry(spark).collect()
    assert len(rows) == 5 * 4
