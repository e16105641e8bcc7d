"""Every query with a SQL check must match it exactly; cells are tiny, so all groups are cut."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from bedtrace.plans import REGISTRY
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if n in REGISTRY))
def test_query_matches_sql(spark, con, name):
    assert compare(name, queries()[name](spark, SF), ORACLES[name], con) == []


@pytest.mark.parametrize("name", sorted(n for n in REGISTRY if n not in ORACLES))
def test_query_without_sql_runs(spark, name):
    df = REGISTRY[name].run(spark, SF)
    rows = df.collect()
    assert rows and len({tuple(r) for r in rows}) > 1


def test_entry(spark):
    assert entry(spark).count() > 0
