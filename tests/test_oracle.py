"""Every registered query against its DuckDB oracle (row count, columns, rows).

Runs at ``TICKSTAT_TEST_SF`` (default sf0.001); the driver checks sf0.01.
"""

import pytest

from tests.oracle_harness import compare
from tickstat.plans.catalog import REGISTRY

NAMES = sorted(REGISTRY)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, sf_small, name):
    res = compare(spark, sf_small, [name], verbose=False)[name]
    assert res == "OK", res
