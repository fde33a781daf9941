"""Every query against its SQL in DuckDB, on the smallest data."""

from __future__ import annotations

import pytest

from sparkloom.plans.catalog import ORACLES, QUERIES
from tests.oracle import connection, differences

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connection(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SMALL).toArrow()
    assert name in ORACLES, "every relational query has its SQL"
    assert differences(got, duck.sql(ORACLES[name]).to_arrow_table()) == []
