import pytest
from oracle import compare

from rolloom.plans.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    if name in ORACLES:
        compare(spark, name, QUERIES[name], ORACLES[name], small)
    else:
        assert QUERIES[name](spark, small).count() >= 0
