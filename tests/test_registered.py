"""A cross-section of the registered queries against their SQL at the smallest scale."""

import os

import pytest

from __spark_entry__ import oracle_sql, queries
from checks.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "mart_01_customer_features",
    "mart_02_product_demand",
    "mart_03_campaign_response",
    "mart_04_returns_risk",
    "mart_05_recommendation_interactions",
    "mart_06_store_week_performance",
    "jn_05_interval_lookback",
    "dq_08_referential_checks",
    "ev_12_uplift_summary",
    "rc_06_cold_start",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data is not here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    assert compare(queries()[name](spark, FOLDER), con, oracle_sql()[name]).startswith("ok")


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())
