"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import compare, connect

from workload import load_all

SF = "/root/testdata/sf0.001"
REGISTRY = load_all()
# Three queries look for things the smallest tables do not hold.
MAY_BE_EMPTY = {"benchmark_means"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_matches_sql(spark, con, name):
    problems, _ = compare(spark, con, REGISTRY[name], SF)
    if name in MAY_BE_EMPTY:
        problems = [p for p in problems if p != "no rows"]
    assert not problems, problems


def test_every_query_has_an_oracle():
    assert not {n for n, q in REGISTRY.items() if q.sql is None}
