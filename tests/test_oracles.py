"""Every registered query against its SQL twin on the smallest given tables."""

import os

import pytest

from tests.check import compare, connect
from tracefold.plans.catalog import load

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    problem, _ = compare(spark, con, QUERIES[name], ORACLES.get(name), SF)
    assert problem is None, problem


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
