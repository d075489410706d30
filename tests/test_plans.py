"""Physical plans: what is pruned, what is shuffled, and what must not appear."""

import re

import pytest

from checks.queries import REGISTRY
from tests import builders as b
from tests.conftest import ts
from tidemark.operators.retention import keep_waits
from tidemark.plans import reports
from tidemark.sources.tables import create_store

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(text):
    """Shuffles of rows by key; the 1-row exchanges of scalar aggregates do not count."""
    return re.findall(r"Exchange (?:hash|range)partitioning\(.*?\)", text)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_no_cross_join_and_no_python(spark, name):
    text = plan(REGISTRY[name](spark, SF))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInPandas"):
        assert operator not in text


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("plans") / "store")
    return create_store(
        spark,
        root,
        query_runtime_stats=b.averaged(spark, [(q, i, 1, q + i) for q in range(4) for i in range(1, 25)]),
        wait_stats=b.waits(spark, [(i, w, 1, 1) for i in range(1, 25) for w in "abcd"]),
        intervals=b.hours(spark, 24),
    )


def fact_scan(text, column):
    return next(line for line in text.splitlines() if "FileScan parquet" in line and column in line)


def test_reports_prune_folders_columns_and_rows(spark, stored):
    text = plan(reports.top_avg_duration(stored, ts(23)))
    assert "SubqueryAdaptiveBroadcast dynamicpruning" in text
    scan = fact_scan(text, "avg_elapsed_time")
    assert "GreaterThan(execution_count,0)" in scan
    assert re.search(r"ReadSchema: struct<query_id:bigint,execution_count:bigint,avg_elapsed_time:bigint>", scan)
    text = plan(reports.top_waits(stored, ts(23)))
    assert "SubqueryAdaptiveBroadcast dynamicpruning" in text
    assert "ReadSchema: struct<wait_type:string,wait_time_ms:bigint>" in fact_scan(text, "wait_time_ms")


def test_expired_wait_folders_are_not_read(spark, stored):
    kept = keep_waits(stored.wait_stats, stored.intervals, ts(12))
    assert re.search(r"PartitionFilters: \[.*Subquery", fact_scan(plan(kept), "wait_time_ms"))
    assert kept.count() == 4 * 13


def test_top_n_and_top_k(spark, stored):
    assert "TakeOrderedAndProject(limit=10" in plan(reports.top_executions(stored, ts(23)))
    text = plan(reports.top3_waits(stored, ts(23)))
    assert text.count("WindowGroupLimit") == 2 and ", 3, Partial" in text


def test_differences_shuffle_history_once(spark):
    text = plan(REGISTRY["runtime_delta"](spark, SF))
    by_key = [s for s in shuffles(text) if "user_id" in s or "query_id" in s]
    # The test workload sums by hour and adds up by user; the differences need the one by key and block.
    assert [re.sub(r"#\d+L?", "", s) for s in sorted(by_key)] == [
        "Exchange hashpartitioning(query_id, _block, 8)",
        "Exchange hashpartitioning(user_id, 8)",
        "Exchange hashpartitioning(user_id, event_type, h, 8)",
    ]
