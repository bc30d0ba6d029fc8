import pytest

from checks.run import compare, connect
from sentilake.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    assert compare(QUERIES[name](spark, DATA), con, ORACLES[name]) is None
