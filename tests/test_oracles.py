import pytest

from tests.oracle import check
from tessera.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    check(spark, QUERIES[name], ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_gives_rows(spark, name):
    # The smallest tables have no set of at least 15 features.
    assert QUERIES[name](spark, SF.replace("0.001", "0.01") if name == "gsea_prerank" else SF).count() > 0
