"""Every registered query against its SQL twin, and what its plan may contain."""

import re

import pytest

import __spark_entry__ as entry_point
from tests.conftest import SMALL
from tools.check import connect, normalise

QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()
MODELS = [n for n in QUERIES if n not in ORACLES]
# a window without partition columns starts with its order or its frame
ONE_TASK_WINDOW = re.compile(r"windowspecdefinition\((?:\S+ (?:ASC|DESC)|specifiedwindowframe)")
# these order bracketed values, or at most one slice of distinct values, in one task
BOUNDED_ORDER = {
    "basic_stats", "regression_metrics", "grid_linear", "corr_spearman", "transfers_vs_readm", "transfers_vs_readm_daynight",
    "roc_points", "roc_auc",
}


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normalise(got) == normalise(want)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_plan_has_no_product(spark, name):
    df = QUERIES[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    if name != "knn_regress":
        assert "ArrowEvalPython" not in plan and "InPandas" not in plan
    assert "BatchEvalPython" not in plan
    if name not in BOUNDED_ORDER:
        assert not ONE_TASK_WINDOW.search(plan)


@pytest.mark.parametrize("name", ["fit_linear_svc", "model_scoreboard", "forest_scores", "boost_scores", "svr_scores", "pca_variance", "silhouette", "split_model", "fuzzy_group_ratio"])
def test_model_queries_give_rows(spark, name):
    assert name in MODELS
    first = QUERIES[name](spark, SMALL).collect()
    assert first
    if name in ("forest_scores", "svr_scores", "pca_variance"):
        assert sorted(map(str, QUERIES[name](spark, SMALL).collect())) == sorted(map(str, first))


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns[-1] == "los" and df.count() > 0
    assert df.schema == entry_point.entry(spark).schema


def test_projection_and_filter_reach_the_scan(spark):
    plan = QUERIES["join_inner"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(c_acctbal,0.0)" in plan
    assert "struct<c_custkey:bigint,c_name:string,c_acctbal:double>" in plan
