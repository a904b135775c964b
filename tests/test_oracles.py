import functools

import pytest
from compare import connect, differences

from strandbook import registry

DIR = "/root/testdata/sf0.001"


@functools.cache
def con():
    return connect(DIR)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, name):
    assert differences(registry.QUERIES[name](spark, DIR), con(), registry.ORACLES[name]) is None
