"""The registered training-data queries against their SQL, on the smallest tables."""

import pytest

from bandwright.llm import queries
from tests.compare import compare, connection


@pytest.fixture(scope="module")
def con(data):
    return connection(data)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, con, data, name):
    assert compare(spark, con, data, name).startswith(("ok", "rows only"))
