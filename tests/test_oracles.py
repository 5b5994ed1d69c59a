"""Every registered query against its SQL at the smallest scale."""

import os

import pytest

from suite import check
from suite.all import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
NAMES = sorted(ORACLES)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    assert check.compare(spark, con, QUERIES[name], ORACLES[name], SF) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
