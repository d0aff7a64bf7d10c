import os

import pytest

import __spark_entry__
from edgetables.registry import QUERIES, SQL
from tests import oracle

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the test tables")


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(SQL) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, connection, name):
    equal, message = oracle.same(QUERIES[name](spark, SF_DIR), connection, SQL[name])
    assert equal, message


def test_entry(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.columns == ["node", "component"] and frame.count() > 0
