"""Every registered query against its SQL, and what its plan must and must not hold."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
import compare  # noqa: E402
from workload import oracles, queries as registered  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(FOLDER), reason="no test data")
NAMES = sorted(registered.REGISTRY)


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


def test_every_query_has_sql():
    assert set(oracles.oracle_sql()) == set(NAMES)
    assert len(NAMES) >= 70


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, con, name):
    good, text = compare.compare(spark, con, FOLDER, name)
    assert good, text


def plan_of(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_plans_have_no_cross_join_and_no_python(spark, name):
    plan = plan_of(spark, name)
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
        assert word not in plan


@pytest.mark.parametrize("name", ["velocity_period_7d", "velocity_date_range",
                                  "approaches_page_date_range", "alert_candidates"])
def test_date_filters_reach_the_scan(spark, name):
    assert "GreaterThanOrEqual(l_shipdate," in plan_of(spark, name)


@pytest.mark.parametrize("name", ["recent_approaches", "approaches_page", "velocity_latest",
                                  "approaches_sort_name", "recent_etl_runs", "alert_candidates"])
def test_top_rows_need_no_global_sort(spark, name):
    plan = plan_of(spark, name)
    assert "TakeOrderedAndProject" in plan
    assert "rangepartitioning" not in plan


def test_only_used_columns_are_read(spark):
    plan = plan_of(spark, "count_approaches")
    assert "ReadSchema: struct<l_partkey:bigint,l_shipdate:timestamp_ntz>" in plan


@pytest.mark.parametrize("name", ["alerts_anti_join", "pending_files", "pending_batches", "fk_orphans"])
def test_absence_is_an_anti_join(spark, name):
    assert "LeftAnti" in plan_of(spark, name)


@pytest.mark.parametrize("name", ["upsert_stats", "load_summary", "transform_summary", "extraction_metadata",
                                  "feed_date_range", "feed_flatten_approaches", "feed_flatten_asteroids"])
def test_documents_are_parsed_once(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("from_json(") == 1


def test_load_counts_need_no_window(spark):
    plan = plan_of(spark, "load_summary")
    assert "Window" not in plan and plan.count("SortMergeJoin") <= 2


def test_a_deep_page_reads_its_tables_twice_at_most(spark, monkeypatch):
    from perigee.operators import paging

    monkeypatch.setattr(paging, "NEAR", 10)  # every page of this size is a deep one
    df = entry.queries()["approaches_page"](spark, FOLDER)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "rangepartitioning" in final and "CartesianProduct" not in final and "NestedLoop" not in final
