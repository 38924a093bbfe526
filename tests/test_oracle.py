"""Every registered query against its SQL on the driver's tables."""

import pytest
from compare import connect, differences

from catalog.oracle import oracle_sql
from catalog.queries import queries

SQL = oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_check_belongs_to_a_query():
    assert set(SQL) <= set(queries())
    assert set(queries()) - set(SQL) == set()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, sf_dir, name):
    got, want, different = differences(queries()[name](spark, sf_dir), con, SQL[name])
    assert not different, different
    assert got == want and got > 0


def test_entry(spark):
    import __spark_entry__
    assert __spark_entry__.entry(spark).columns == ["measure", "base", "finetuned"]
