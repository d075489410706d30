"""Collection runs end to end, written to and read back from disk."""

from dataclasses import replace

import pytest

from tests import builders as b
from tests.conftest import rows, ts
from tests.test_ingest import NS, xml
from tidemark.config import StoreConfig
from tidemark.plans import reports
from tidemark.plans.gather import gather, publish
from tidemark.schemas import (
    CACHED_PLANS, DATABASES, METRICS, PLAN_ATTRIBUTES, PLAN_XML, SQL_TEXT, WAIT_COUNTER_INPUT,
)
from tidemark.sources import catalog, log
from tidemark.sources.tables import (
    create_store, publish_run, purge_store, read_store, replace_intervals, stored_files, wait_type_filter, write_store,
)
from tidemark.store import Inputs

ACTIVE = StoreConfig(collection_active=True, mode="centralized")
STATS = (
    "plan_handle binary, sql_handle binary, query_hash binary, query_plan_hash binary, "
    "statement_start_offset int, statement_end_offset int, creation_time timestamp_ntz, "
    "last_execution_time timestamp_ntz, execution_count long, "
    + ", ".join(f"{s}_{m} long" for m in METRICS for s in ("total", "last", "min", "max"))
)


def inputs(spark, counters, waits):
    """``counters``: ``(handle, hash, count, total)``; the handle ``own`` reads the store's schema."""
    handles = sorted({c[0] for c in counters})
    stats = [
        (h, h, q, b"x", 0, -1, ts(0), ts(1), n, *([total, 1, 1, 1] * len(METRICS))) for h, q, n, total in counters
    ]
    return Inputs(
        cached_plans=spark.createDataFrame(
            [(h, "Compiled Plan", "Adhoc", 5, 1, 8) for h in handles], CACHED_PLANS
        ),
        plan_attributes=spark.createDataFrame([(h, "dbid", "1") for h in handles], PLAN_ATTRIBUTES),
        plan_xml=spark.createDataFrame(
            [(h, xml(schema="telemetry" if h == b"own" else "dbo")) for h in handles], PLAN_XML
        ),
        query_stats=spark.createDataFrame(stats, STATS),
        sql_text=spark.createDataFrame([(h, f"select '{h.decode()}'") for h in handles], SQL_TEXT),
        wait_counters=spark.createDataFrame([(w, n, t, t, n) for w, n, t in waits], WAIT_COUNTER_INPUT),
        databases=spark.createDataFrame([(1, "shop")], DATABASES),
    )


@pytest.fixture
def root(spark, tmp_path):
    path = str(tmp_path / "store")
    create_store(
        spark,
        path,
        monitored_databases=spark.createDataFrame([("shop",)], "database_name string"),
        wait_type_filter=b.wait_filter(spark, "IDLE"),
    )
    return path


def collect(spark, root, source, hour, config=ACTIVE):
    run = gather(source, read_store(spark, root), config, ts(hour))
    publish_run(run.changes, root, run.interval_ids)
    return run


def gathered(run):
    """The two intervals a run computes."""
    return run.changes["query_runtime_stats"]


def test_three_runs(spark, root):
    first = collect(spark, root, inputs(spark, [(b"p1", b"a", 2, 10), (b"own", b"z", 9, 9)], [("IO", 1, 5), ("IDLE", 1, 1)]), 1)
    assert rows(first.stages["self_plans"]) and first.skipped is None
    second = collect(
        spark, root,
        inputs(spark, [(b"p1", b"a", 6, 30), (b"p2", b"b", 4, 400), (b"own", b"z", 9, 9)], [("IO", 1, 5), ("IDLE", 3, 9)]), 2,
    )
    # The store a run returns is the one read back.
    assert rows(second.store.intervals) == rows(read_store(spark, root).intervals)
    columns = second.store.query_runtime_stats.columns
    assert rows(gathered(second), *columns) == rows(read_store(spark, root).query_runtime_stats, *columns)
    collect(spark, root, inputs(spark, [(b"p1", b"a", 7, 33), (b"p2", b"b", 9, 900)], [("IO", 4, 25), ("IDLE", 5, 9)]), 3)

    store = read_store(spark, root)
    assert rows(store.intervals) == [(1, ts(1), ts(2)), (2, ts(2), ts(3)), (3, ts(3), None)]
    assert rows(store.plan_dbid) == [(b"own", 1), (b"p1", 1), (b"p2", 1)]
    assert rows(store.plans, "plan_handle", "plan_database", "plan_optimization", "xml_processed") == [
        (b"p1", "shop", "Full", 1), (b"p2", "shop", "Full", 1),
    ]
    assert rows(store.queries, "query_id", "query_hash", "query_statement_text") == [
        (1, b"a", "select 'p1'"), (2, b"b", "select 'p2'"),
    ]
    assert rows(store.query_runtime_stats, "query_id", "interval_id", "execution_count", "total_rows", "avg_rows") == [
        (1, 1, 4, 20, 5), (1, 2, 1, 3, 3), (1, 3, 7, 33, 0), (2, 2, 5, 500, 100), (2, 3, 9, 900, 0),
    ]
    # IO stood still in the first interval, so its row is gone there.
    assert rows(store.wait_stats, "interval_id", "wait_type", "waiting_tasks_count") == [
        (1, "IDLE", 2), (2, "IDLE", 2), (2, "IO", 3), (3, "IDLE", 5), (3, "IO", 4),
    ]
    messages = sorted(rows(store.activity_log, "log_run_id", "log_id", "log_message"))
    assert [m[2] for m in messages if m[0] == 2] == [
        log.STARTED,
        "captured 1 new plan(s)",
        "captured 1 new queries",
        "captured 1 runtime statistics",
        "captured 2 wait statistics",
        log.FINISHED,
    ]
    assert sorted(m[1] for m in messages) == list(range(1, 19))
    assert rows(reports.top_avg_duration(store, ts(3))) == [(100, 2), (4, 1)]
    assert rows(reports.top_waits(store, ts(3))) == [("IO", 20)]


def snapshots_of(spark, hour):
    """What the server shows at an hour: counters grow, one query comes late, one wait stands still at times."""
    counters = [(b"p1", b"a", 2 * hour, 10 * hour * hour)] + ([(b"p2", b"b", hour, 7 * hour)] if hour > 1 else [])
    return inputs(spark, counters, [("IO", 3 * hour, 5 * hour), ("NET", 1 + hour // 3, 4 + hour // 3)])


FACTS = ("query_runtime_stats", "wait_stats")


@pytest.mark.parametrize("stopped,half", [({2, 3}, False), ({2}, True)])
def test_runs_that_stopped_before_their_differences_are_made_up_for(spark, root, tmp_path, stopped, half):
    undisturbed = str(tmp_path / "undisturbed")
    create_store(
        spark,
        undisturbed,
        monitored_databases=spark.createDataFrame([("shop",)], "database_name string"),
        wait_type_filter=b.wait_filter(spark, "IDLE"),
    )
    for hour in range(1, 5):
        collect(spark, undisturbed, snapshots_of(spark, hour), hour)
        run = gather(snapshots_of(spark, hour), read_store(spark, root), ACTIVE, ts(hour))
        if hour not in stopped:
            publish_run(run.changes, root, run.interval_ids)
            continue
        newest = max(run.interval_ids)
        opened = {n: df for n, df in run.changes.items() if n != "activity_log"}
        for name in FACTS:
            opened[name] = opened[name].filter(f"interval_id = {newest}")
        publish_run(opened, root, [newest])
        if half and newest > 1:  # the differences of one fact got through
            publish_run({"wait_stats": run.changes["wait_stats"]}, root, run.interval_ids)
    left, right = read_store(spark, root), read_store(spark, undisturbed)
    for name in (*FACTS, "intervals", "plans", "queries", "plan_dbid"):
        columns = sorted(getattr(right, name).columns)
        assert rows(getattr(left, name), *columns) == rows(getattr(right, name), *columns), name
    states = rows(left.query_runtime_stats, "interval_id", "is_delta")
    assert set(states) == {(1, True), (2, True), (3, True), (4, False)}


def test_strict_reports_leave_lifetime_counters_out(spark, root):
    for hour in (1, 2):
        collect(spark, root, inputs(spark, [(b"p1", b"a", 2 * hour, 10), (b"gone", b"c", 9, 9000)][: 3 - hour], [("IO", hour, 5)]), hour)
    store = read_store(spark, root)
    assert len(rows(reports.top_executions(store, ts(2)))) == 2
    assert len(rows(reports.top_executions(store, ts(2), strict=True))) == 1
    assert rows(reports.top_waits(store, ts(2), strict=True)) == [("IO", 0)]


def test_an_interval_whose_waits_all_stood_still_is_emptied(spark, root):
    source = inputs(spark, [(b"p1", b"a", 2, 10)], [("IO", 1, 5)])
    collect(spark, root, source, 1)
    collect(spark, root, source, 2)
    assert rows(read_store(spark, root).wait_stats, "interval_id") == [(2,)]


def test_publishing_again_changes_no_fact(spark, root):
    source = inputs(spark, [(b"p1", b"a", 2, 10)], [("IO", 1, 5)])
    run = collect(spark, root, source, 1)
    before = rows(read_store(spark, root).query_runtime_stats)
    replace_intervals(run.changes["query_runtime_stats"], root, "query_runtime_stats", run.interval_ids)
    assert rows(read_store(spark, root).query_runtime_stats) == before
    with pytest.raises(ValueError):
        replace_intervals(run.changes["plans"], root, "plans")


def test_gates(spark, root):
    source = inputs(spark, [(b"p1", b"a", 2, 10)], [("IO", 1, 5)])
    store = read_store(spark, root)
    assert gather(source, store, StoreConfig(), ts(1)).skipped == log.NOT_ACTIVE
    nothing = store.with_frames(monitored_databases=store.monitored_databases.limit(0))
    assert gather(source, nothing, ACTIVE, ts(1)).skipped == log.NOTHING_MONITORED
    budget = catalog.within_budget(catalog.table_catalog(spark, stored_files(spark, root)), 0)
    full = gather(source, store, replace(ACTIVE, maximum_size_mb=0), ts(1), budget)
    assert full.skipped == log.STORE_FULL.format(0)
    assert list(full.changes) == ["activity_log"] and rows(full.changes["activity_log"], "log_run_id") == [(1,)]


def test_quiet_runs_log_only_why_they_were_skipped(spark, root):
    source = inputs(spark, [(b"p1", b"a", 2, 10)], [("IO", 1, 5)])
    store = read_store(spark, root)
    config = replace(ACTIVE, data_cleanup_active=True)
    quiet = gather(source, store, config, ts(1), log_progress=False)
    assert quiet.changes["activity_log"].isEmpty() and quiet.store.activity_log.isEmpty()
    assert rows(quiet.changes["queries"], "query_hash") == [(b"a",)]
    off = StoreConfig(data_cleanup_active=True)
    skipped = gather(source, store, off, ts(1), log_progress=False)
    assert rows(skipped.changes["activity_log"], "log_message") == [(log.NOT_ACTIVE,)]


def test_cleanup_follows_even_a_skipped_run(spark, root, tmp_path):
    collect(spark, root, inputs(spark, [(b"p1", b"a", 2, 10)], [("IO", 1, 5)]), 1)
    config = StoreConfig(data_cleanup_active=True, data_cleanup_threshold=3)
    run = gather(inputs(spark, [(b"p1", b"a", 2, 10)], []), read_store(spark, root), config, ts(1, day=9))
    assert run.skipped == log.NOT_ACTIVE
    assert rows(run.changes["activity_log"], "log_message") == [(log.NOT_ACTIVE,)]
    other = str(tmp_path / "kept")
    write_store(run.store, other)
    assert read_store(spark, other).query_runtime_stats.isEmpty()
    publish(run, root)
    kept = read_store(spark, root)
    assert kept.query_runtime_stats.count() == kept.queries.count() == kept.plans.count() == 0
    assert rows(kept.activity_log, "log_message") == [(log.CLEANED,), (log.NOT_ACTIVE,)]
    assert kept.intervals.count() == 1 and kept.plan_dbid.count() == 1


def test_purge_in_place(spark, root):
    collect(spark, root, inputs(spark, [(b"p1", b"a", 2, 10)], [("IO", 1, 5)]), 1)
    purge_store(spark, root)
    left = {name for name, df in read_store(spark, root).tables().items() if not df.isEmpty()}
    assert left == {"monitored_databases", "wait_type_filter"}
    collect(spark, root, inputs(spark, [(b"p1", b"a", 2, 10)], [("IO", 1, 5)]), 1)
    assert rows(read_store(spark, root).intervals, "interval_id") == [(1,)]


def test_wait_filter_lists_each_type_once(spark):
    assert rows(wait_type_filter(spark, ["A", "B", "A"])) == [("A", True), ("B", True)]


def test_namespace_of_fixtures():
    assert NS in xml()
