"""Every registered query at the smallest scale: equal to its SQL twin, or at least some rows."""

import os

import pytest

import oracle
import __spark_entry__ as entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        assert oracle.compare(spark, con, QUERIES[name], SQL[name], SF_DIR) is None
    else:
        assert QUERIES[name](spark, SF_DIR).count() > 0


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["conv_id", "messages", "tokens_before", "tokens_after"]
    assert out.filter("tokens_after > tokens_before").count() == 0
