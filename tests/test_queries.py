"""Every registered query against its SQL on the smallest tables; those without SQL must run and have rows' schema."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connection


@pytest.fixture(scope="module")
def con(data):
    return connection(data)


CORE = [n for m in entry._modules() if not m.__name__.startswith("bandwright.llm") for n in m.QUERIES]


@pytest.mark.parametrize("name", CORE)
def test_query(spark, con, data, name):
    assert compare(spark, con, data, name).startswith(("ok", "rows only"))


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0
