"""Every query of the timeline engine that has SQL gives the SQL's rows."""

import pytest

from cuebeam import catalog
from tests.oracle import assert_same, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, con, name):
    assert_same(catalog.queries()[name](spark, SF), con, catalog.oracle_sql()[name])


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
