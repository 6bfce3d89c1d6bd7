"""Every query of the package with a SQL twin gives the same rows as the twin, at the smallest scale."""

import oracle
import pytest

from lurewatch import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, con, name):
    assert not oracle.differences(spark, con, name, registry.QUERIES[name], registry.ORACLES[name], SF)
