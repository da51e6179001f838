"""Every registered mesh query against its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest
from conftest import rows_of

from meshlake.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, duck, name):
    frame = QUERIES[name](spark, sf)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not [bad for bad in ("CartesianProduct", "PythonUDF", "ArrowEvalPython", "MapInArrow", "FlatMapGroups") if bad in plan]
    got, want = frame.toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


def test_no_big_theta_joins(spark, sf):
    for name in ("d01_zmoc", "d09_meridional_heat", "d11_streamfunction", "a07_hmean_weighted", "j02_elems_to_nodes"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
