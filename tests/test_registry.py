"""Every registered payment query against its oracle SQL."""

import pytest

from tests.oracle import difference
from txnflow.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert difference(df, ORACLES[name], SF) == ""
    else:
        assert df.count() > 0
