"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from opinara.verification import compare, registry

SF = "/root/testdata/sf0.001"
registry.load_all()
# Their SQL side walks or resamples for long; the comparison tool covers them.
SLOW = {"a20_permutation_test", "a20_permutation_test_generator", "st1_sliding_window_limiter"}


@pytest.fixture(scope="module")
def con():
    pytest.importorskip("duckdb")
    return compare.duck(SF)


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in SLOW])
def test_query(spark, con, name):
    ok, message = compare.compare(spark, con, SF, name, registry.QUERIES[name], registry.SQL.get(name))
    assert ok, message
