"""Every query with SQL gives what the SQL gives."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["scenario", "flows"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, con, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    assert compare(df, con.sql(entry.oracle_sql()[name])) == ""
