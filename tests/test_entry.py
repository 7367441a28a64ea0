import os

import pytest

import __spark_entry__ as e

DATA = "/root/testdata/sf0.001"


def test_names():
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_flagship(spark):
    out = e.entry(spark)
    assert out.columns[:2] == ["gid", "appid"] and out.count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_plans(spark):
    """The latest version is pruned before the shuffle, and scans read what they need."""
    plan = e.queries()["lake_latest"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "props" not in plan
    plan = e.queries()["games_range_filters"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "o_totalprice" not in plan
