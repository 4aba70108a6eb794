"""Every query runs over its whole tables; those with SQL give what DuckDB gives."""

import pytest

from evigraph import queries as Q
from tests.oracle import connect, rows


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_against_sql(spark, sf_dir, con, name):
    got, want = Q.QUERIES[name](spark, sf_dir).toPandas(), con.execute(Q.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_runs(spark, sf_dir, name):
    df = Q.QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 8
