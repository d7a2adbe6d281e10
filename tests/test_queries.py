"""Every registered query: the shape of its plan, and its rows against the DuckDB counterpart."""

import re

import pytest

import oracle
from doclake.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def test_every_query_has_a_counterpart():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # the first argument of a window is its partitioning; without one it would start with an order or a frame
    assert not re.search(r"windowspecdefinition\((?:specifiedwindowframe|[^,()]* (?:ASC|DESC) )", plan)
    got = oracle.spark_rows(df)
    want = oracle.duck_rows(con, ORACLES[name].replace("/root/testdata/sf0.01/", SF + "/"))
    assert got[1], "no rows"
    assert oracle.difference(got, want) is None


@pytest.mark.parametrize("name", ["md_headings", "html_inline"])
def test_short_rows_are_dealt_out_before_they_become_documents(spark, name):
    """One file of customers is one split; its documents are the work of all tasks."""
    assert spark.read.parquet(f"{SF}/customer.parquet").rdd.getNumPartitions() == 1
    assert "Exchange RoundRobinPartitioning(8), REPARTITION_BY_NUM" in QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
