"""Every registered query: equal to its SQL, and planned without nested loops."""

import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LIBRARY = {name: query for m in entry._library() for name, query in m.QUERIES.items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(LIBRARY))
def test_query_equals_sql(spark, con, name):
    ok, note = compare(spark, con, name, LIBRARY[name], entry.oracle_sql()[name], SF)
    assert ok, note


def test_every_query_has_sql():
    assert set(LIBRARY) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(LIBRARY))
def test_plan_has_no_nested_loop_or_single_task_window(spark, name):
    df = LIBRARY[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    # a window without a partition key would pull the whole table into one task
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Window [" in line:
            assert not any("Exchange SinglePartition" in below for below in lines[i + 1 : i + 4]), line


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 6
