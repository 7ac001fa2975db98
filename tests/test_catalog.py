"""Every registered query next to its SQL twin on the smallest tables."""

import pytest
from check import compare, connect

from periodlens.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SLOW = {n for n in QUERIES if n.startswith("model_")}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_query_equals_sql(spark, con, name):
    diff, rows = compare(QUERIES[name](spark, SF), con, ORACLES[name])
    assert diff is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES and n not in SLOW])
def test_query_gives_rows(spark, name):
    assert len(QUERIES[name](spark, SF).collect()) > 0
