"""Every registered query with SQL against that SQL, on the smallest tables."""

import pytest

import loomwright.plans.q_io
import loomwright.plans.q_joins
import loomwright.plans.q_lines
import loomwright.plans.q_metrics  # noqa: F401
from loomwright.plans.catalog import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(name, spark, small, same):
    same(QUERIES[name](spark, small), ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_without_sql(name, spark, small):
    """Rows come, and two runs give the same. What the rows must be is tested in test_properties (lineage closure, placement, sampling),
    test_matching (fuzzy join, vector lists), test_longctx (folded form) and test_streams (fresh ids)."""
    one, two = (sorted(map(repr, QUERIES[name](spark, small).collect())) for _ in range(2))
    assert one and one == two
