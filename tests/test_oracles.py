"""Every query of the engine's own against its DuckDB SQL, on the smallest data."""

import compare
import pytest

from presswell.plans import kept, registry, text, warehouse, warehouse_oracles  # noqa: F401


@pytest.fixture(scope="module")
def con(small):
    return compare.connect(small)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_oracle(spark, small, con, name):
    assert compare.differences(registry.QUERIES[name](spark, small), registry.ORACLES[name], con) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs_without_oracle(spark, small, name):
    assert registry.QUERIES[name](spark, small).count() > 0
