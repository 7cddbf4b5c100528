"""Every registered query against its SQL twin on the driver's tables."""

import os

import pytest

from conftest import SF
from galeledger.catalog import REGISTRY, SQL
from tools.check_oracle import compare, connect

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, con, name):
    assert compare(spark, con, name, SF) == ""


def test_every_twin_has_a_query():
    assert set(SQL) <= set(REGISTRY)
