"""Plan hygiene of every registered query (what would hurt at scale)."""

import os

import pytest

from tidewater.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")

FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin",
             "Window ", "collect_list", "collect_set")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_rows_no_pairs_no_windows(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for op in FORBIDDEN:
        assert op not in plan, f"{name} uses {op}"


def test_scans_read_only_needed_columns(spark):
    plan = QUERIES["refined_speed"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,value:double>" in plan
