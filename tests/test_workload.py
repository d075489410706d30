"""The derived workload against the events it comes from."""

import re

import pytest
from pyspark.sql import functions as F

from checks.queries import REGISTRY
from tests.conftest import rows
from tidemark.operators.deltas import catch_up, runtime_delta, runtime_delta_step, wait_delta
from tidemark.operators.snapshots import runtime_snapshot, wait_snapshot
from tidemark.sources.workload import EVICT_HOURS, Workload, hour_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def workload(spark):
    return Workload(spark, SF)


def test_wait_deltas_are_the_hourly_sums_of_the_events(workload):
    events = workload.table("events").select(
        F.concat("event_type", F.lit("_"), (F.col("user_id") % 20).cast("string")).alias("wait_type"),
        (hour_of(F.col("ts")) + 1).cast("int").alias("interval_id"),
        F.round(F.col("value") * 100).cast("long").alias("ms"),
    )
    seen_before = wait_snapshot(workload.wait_counters()).select("wait_type", "interval_id")
    hourly = events.groupBy("wait_type", "interval_id").agg(F.count("*").alias("n"), F.sum("ms").alias("ms"))
    expected = hourly.join(seen_before, ["wait_type", "interval_id"], "left_semi").filter("interval_id < 720")
    got = wait_delta(wait_snapshot(workload.wait_counters()), strict=True)
    assert rows(got, "wait_type", "interval_id", "waiting_tasks_count", "wait_time_ms") == rows(expected)


def test_runtime_deltas_without_an_eviction_are_the_hourly_counts(workload):
    """Where no handle comes or goes between two runs, the step is what happened in the hour."""
    stats = workload.query_stats().select("user_id", "plan_handle", "interval_id")
    now = stats.groupBy("user_id", "interval_id").agg(F.sort_array(F.collect_set("plan_handle")).alias("handles"))
    later = now.select("user_id", (F.col("interval_id") - 1).alias("interval_id"), "handles")
    stable = now.join(later, ["user_id", "interval_id", "handles"]).select(
        F.col("user_id").alias("query_id"), "interval_id"
    )
    events = workload.table("events").select(
        F.col("user_id").alias("query_id"), (hour_of(F.col("ts")) + 1).cast("int").alias("interval_id")
    )
    hourly = events.groupBy("query_id", "interval_id").agg(F.count("*").alias("n"))
    steps = runtime_delta(workload.runtime_snapshots(), strict=True).select(
        "query_id", "interval_id", "execution_count"
    )
    compared = (
        steps.join(stable, ["query_id", "interval_id"])
        .join(hourly, ["query_id", "interval_id"], "left")
        .select("execution_count", F.coalesce("n", F.lit(0)).alias("n"))
    )
    assert compared.count() > 5000
    assert compared.filter("execution_count <> n").count() == 0


def test_matching_on_four_keys_finds_every_query(workload):
    matched = runtime_snapshot(workload.queries_with_origin(), workload.keyed_query_stats())
    folded = workload.runtime_snapshots()
    assert rows(matched, *folded.columns) == rows(folded, *folded.columns)


def test_handles_are_evicted(workload):
    idle = workload.query_stats().select(
        (F.col("interval_id") - 1 - hour_of(F.col("last_execution_time"))).alias("hours")
    )
    assert idle.agg(F.min("hours"), F.max("hours")).first() == (1, EVICT_HOURS)


@pytest.fixture
def few_events(spark, tmp_path):
    """Handles that come, stay, are evicted and come again; a user of the last day alone, and one without an id."""
    hours = {1: [0, 3, 30, 150, 199], 2: [10, 100, 175, 176, 180], 3: [195], None: [5, 60, 190]}
    events = [(u, f"'{t}'", h) for u, of_user in hours.items() for h in of_user for t in ("view", "buy")[: 1 + h % 2]]
    values = ", ".join(
        f"({i}L, timestamp_ntz'2024-01-01 00:10:00' + interval {h} hour, {'NULL' if u is None else u}, {t}, {i}.5D)"
        for i, (u, t, h) in enumerate(events)
    )
    spark.sql(
        f"SELECT id AS event_id, ts, CAST(user AS long) AS user_id, kind AS event_type, value, '{{\"k\": 3}}' AS props "
        f"FROM VALUES {values} AS t(id, ts, user, kind, value)"
    ).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_snapshots_from_an_interval_on_are_those_of_all(spark, few_events):
    w = Workload(spark, few_events)
    for since in (-1, 1, 30, 150, 199, 200, 201):
        whole = w.runtime_snapshots().filter(F.col("interval_id") >= since)
        assert rows(w.runtime_snapshots(since=F.lit(since))) == rows(whole)


def test_catch_up_differences_the_history_once(spark, few_events):
    """The history is read for its own rows alone, not to look for snapshots that wait for their differences."""
    made_up = REGISTRY["catch_up"](spark, few_events)
    assert len(re.findall(r"Window \[.*lead\(interval_id", made_up._jdf.queryExecution().optimizedPlan().toString())) == 1
    w = Workload(spark, few_events)
    snapshots, newest = w.runtime_snapshots(), 200
    stored = w.runtime_history().filter(F.col("interval_id") < newest - 24).unionByName(
        snapshots.filter(F.col("interval_id").between(newest - 24, newest - 1)).withColumn("is_delta", F.lit(False))
    )
    later = snapshots.filter(F.col("interval_id") == newest)
    whole = catch_up(stored, later, runtime_delta_step).unionByName(later.withColumn("is_delta", F.lit(False)))
    columns = sorted(whole.columns)
    assert rows(later) and rows(made_up, *columns) == rows(whole, *columns)
