import re

import pytest

from logloom.llm import registry
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"


def test_a_query_for_every_operator():
    assert {int(re.match(r"op(\d+)_", n).group(1)) for n in registry.QUERIES} == set(range(1, 14))
    assert set(registry.ORACLES) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLES:
        assert difference(df, connect(SF), registry.ORACLES[name]) is None
    else:
        assert df.count() > 0
