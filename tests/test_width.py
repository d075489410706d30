"""Long histories are dealt over as many tasks as they need, whatever the session's number of partitions."""

import re

import pytest
from pyspark.sql import functions as F

from checks.queries import REGISTRY
from tests.conftest import rows
from tests.test_deltas import snapshot_inputs
from tests.test_plans import plan, shuffles
from tidemark.operators.snapshots import runtime_snapshot
from tidemark.schemas import QUERY_RUNTIME_STATS
from tidemark.sources import workload

SF = "/root/testdata/sf0.001"
NAMES = ("runtime_delta_strict", "runtime_delta_zeroed", "retention_stats", "retention_throttled", "runtime_snapshot")


def wide(text):
    """Partitions of each shuffle that deals rows spread over the runs by query."""
    found = re.findall(r"hashpartitioning\((?:user_id|query_id|query_id, _block), (\d+)\)", re.sub(r"#\d+L?", "", " ".join(shuffles(text))))
    return {int(n) for n in found}


@pytest.mark.parametrize("name", NAMES)
def test_partitions_follow_the_events(spark, monkeypatch, name):
    before = rows(REGISTRY[name](spark, SF))
    monkeypatch.setattr(workload, "EVENTS_PER_TASK", 50)
    events = spark.read.parquet(f"{SF}/events.parquet").count()
    df = REGISTRY[name](spark, SF)
    assert -(-events // 50) in wide(plan(df))
    assert rows(df) == before


def test_snapshots_folded_in_two_steps_are_the_same(spark):
    """Queries found by two keys, counters that come twice and two plans of a query, over two blocks."""
    queries, stats = snapshot_inputs(spark)
    later = stats.withColumn("interval_id", F.col("interval_id") + 1024)
    stats = stats.unionByName(later).unionByName(stats.limit(1))
    queries = queries.unionByName(queries.limit(1))
    for match_creation_time in (True, False):
        expected = runtime_snapshot(queries, stats, match_creation_time)
        got = runtime_snapshot(queries, stats, match_creation_time, partitions=3)
        assert got.columns == expected.columns == QUERY_RUNTIME_STATS.names
        assert rows(got) == rows(expected) and got.count()


def test_matched_counters_are_folded_where_they_are(spark):
    """The wide rows travel twice: to be matched, and folded, by query and block."""
    text = plan(REGISTRY["runtime_snapshot"](spark, SF))
    by_key = [re.sub(r"#\d+L?", "", s) for s in shuffles(text)]
    assert "Exchange hashpartitioning(query_id, _block, 8)" in by_key
    assert not [s for s in by_key if s.startswith("Exchange hashpartitioning(query_id, interval_id")]


def test_statements_without_text_are_not_paired(spark):
    """Without hashes a handle of n statements gives n * n pairs; those that have no text go before that."""
    text = plan(REGISTRY["new_queries"](spark, SF))
    semi = [line for line in text.splitlines() if "LeftSemi" in line]
    assert len(semi) == 1 and "[sql_handle" in semi[0]
