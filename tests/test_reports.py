from datetime import timedelta

import pytest

from tests import builders as b
from tests.conftest import rows, ts
from tidemark.plans import charts, reports

HOUR = timedelta(hours=1)


@pytest.fixture(scope="module")
def runtime_store(spark):
    """Six hourly intervals, the last open; 'now' is 05:00, so a two-hour look-back sees 3, 4 and 5."""
    facts = b.averaged(
        spark,
        [
            (1, 3, 2, 10), (1, 4, 2, 13), (1, 5, 1, 10),
            (2, 4, 5, 30), (2, 5, 0, 999), (2, 6, 50, 999),
            (3, 4, 1, 500),
            (4, 4, -2, 70),
            (5, 4, 9, 30),
            (6, 1, 9, 9999),
            (7, 4, 1, 8888),
        ],
    )
    return b.store(
        spark,
        query_runtime_stats=facts,
        intervals=b.hours(spark, 6),
        queries=b.queries(
            spark, [(1, 10, b"a"), (2, 10, b"a"), (3, 11, b"b"), (4, 12, b"b"), (5, 12, b"b"), (6, 12, b"c")]
        ),
        plans=b.plans(spark, [(10, "x", "Adhoc"), (11, "y", "Proc"), (12, "y", "Proc")]),
        excluded_queries=b.ids(spark, 3, 99),
    )


def test_top_avg_duration(runtime_store):
    got = reports.top_avg_duration(runtime_store, ts(5), 2 * HOUR).collect()
    # Query 3 is excluded, 4 never ran, 6 is too old, 7 has no query row; 2 and 5 tie.
    assert [tuple(r) for r in got] == [(30, 2), (30, 5), (11, 1)]


def test_top_executions_and_limit(runtime_store):
    got = reports.top_executions(runtime_store, ts(5), 2 * HOUR, limit=2).collect()
    assert [tuple(r) for r in got] == [(9, 5), (5, 1)]
    assert [tuple(r) for r in reports.top_executions(runtime_store, ts(5), 2 * HOUR).collect()][:3] == [
        (9, 5), (5, 1), (5, 2),
    ]


def test_time_reports_sum_by_label_and_database(runtime_store):
    expected = [("03:00:00", "x", 10), ("04:00:00", "x", 43), ("04:00:00", "y", 30), ("05:00:00", "x", 10)]
    for report, column in ((reports.worker_time, "avg_worker_time"), (reports.elapsed_time, "avg_elapsed_time")):
        assert rows(report(runtime_store, ts(5), 2 * HOUR), "time_date", "database_name", column) == expected
    got = reports.io(runtime_store, ts(5))
    assert rows(got, "time_date", "database_name", "avg_logical_reads", "avg_logical_writes") == [
        ("04:00:00", "x", 43, 43), ("04:00:00", "y", 30, 30), ("05:00:00", "x", 10, 10),
    ]
    matrix = charts.chart_matrix(
        reports.worker_time(runtime_store, ts(5), 2 * HOUR), "time_date", "database_name", "avg_worker_time", ["x", "y"]
    )
    assert rows(matrix) == [("03:00:00", 10, None), ("04:00:00", 43, 30), ("05:00:00", 10, None)]


def test_equal_times_of_different_days_merge_unless_asked_not_to(spark):
    store = b.store(
        spark,
        query_runtime_stats=b.averaged(spark, [(1, 1, 1, 5), (1, 25, 1, 7)]),
        intervals=b.hours(spark, 30),
        queries=b.queries(spark, [(1, 10, b"a")]),
        plans=b.plans(spark, [(10, "x", "Adhoc")]),
    )
    day = timedelta(days=3)
    merged = reports.worker_time(store, ts(5, day=2), day)
    assert rows(merged) == [("01:00:00", "x", 12)]
    apart = reports.worker_time(store, ts(5, day=2), day, bucket="timestamp")
    assert rows(apart) == [(ts(1, day=1), "x", 5), (ts(1, day=2), "x", 7)]


def test_distinct_queries_group_on_the_full_timestamp(spark):
    data = [(1, 1, 1, 1, ts(4, 0, 0, micro=100)), (1, 2, 1, 1, ts(4, 0, 0, micro=100)),
            (2, 1, 1, 1, ts(4, 0, 0, micro=100)), (3, 1, 1, 1, ts(4, 0, 0, micro=900)),
            (4, 1, 1, 1, ts(1)), (9, 1, 1, 1, ts(4, 30))]
    store = b.store(spark, query_runtime_stats=b.runtime(spark, data), excluded_queries=b.ids(spark, 9))
    frame = reports.distinct_queries(store, ts(5))
    assert rows(frame) == [("04:00:00", 1), ("04:00:00", 2)]
    assert rows(charts.chart_sums(frame, "time_date", ["distinct_queries"])) == [("04:00:00", 3)]


def test_item_count(spark, runtime_store):
    store = runtime_store.with_frames(wait_stats=b.waits(spark, [(1, "a", 1, 1), (2, "a", 1, 1)]))
    got = rows(reports.item_count(store), "database", "queries", "plans", "intervals", "runtime_stats", "wait_stats")
    assert got == [("x", 2, 1, 6, 6, 2), ("y", 4, 2, 6, 4, 2)]


def test_plan_variety_and_counts(spark, runtime_store):
    assert rows(reports.plan_variety(runtime_store)) == [("Adhoc", 1), ("Proc", 2)]
    store = runtime_store.with_frames(wait_type_filter=b.wait_filter(spark, "a", "b"))
    assert reports.excluded_count(store).first()[0] == 2
    assert reports.wait_filter_count(store).first()[0] == 2
    assert charts.exclusion_caption(reports.excluded_count(store)).first()[0] == "Excluded queries: 2"
    assert charts.filter_caption(reports.wait_filter_count(store)).first()[0] == "Filtered wait types: 2"


def test_multiple_plans_reaches_into_other_databases(spark):
    store = b.store(
        spark,
        queries=b.queries(
            spark,
            [(1, 10, b"h"), (2, 11, b"h"), (3, 12, b"h"), (4, 13, b"g"), (5, 14, b"g"), (6, 10, None), (7, 10, None)],
        ),
        plans=b.plans(
            spark, [(10, "x", "A"), (11, "x", "A"), (12, "y", "A"), (13, "x", "A"), (14, "x", "A")]
        ),
        excluded_queries=b.ids(spark, 5),
    )
    # Shape h repeats in x only, but its plan in y shows up too; g repeats only through an excluded query.
    assert rows(reports.multiple_plans(store)) == [("x", 1, 10), ("x", 1, 11), ("x", 1, 12)]
    assert rows(reports.multiple_plans(store, same_db=True)) == [("x", 1, 10), ("x", 1, 11)]
    assert rows(charts.plan_counts(reports.multiple_plans(store))) == [(1, "x", 3)]


def test_last_log_keeps_all_rows_of_the_latest_run(spark):
    log = b.frame(spark, "activity_log", [(1, 1, ts(), "a"), (2, 2, ts(), "b"), (3, 2, ts(), "c")])
    assert rows(reports.last_log(b.store(spark, activity_log=log)), "log_message") == [("b",), ("c",)]


@pytest.fixture(scope="module")
def wait_store(spark):
    data = [
        (4, "a", 1, 10), (4, "b", 2, 40), (4, "c", 3, 30), (4, "d", 4, 20), (4, "noise", 9, 900),
        (5, "a", 1, 5), (5, "d", 1, 80), (6, "a", 7, 700), (1, "a", 7, 700),
    ]
    return b.store(
        spark,
        wait_stats=b.waits(spark, data),
        intervals=b.hours(spark, 6),
        wait_type_filter=b.wait_filter(spark, "noise"),
    )


def test_top_waits_and_shares(wait_store):
    frame = reports.top_waits(wait_store, ts(5), HOUR)
    assert [tuple(r) for r in frame.collect()] == [("d", 100), ("b", 40), ("c", 30), ("a", 15)]
    shares = charts.percent_of_total(frame, "total_wait_time")
    assert [round(r["share"], 4) for r in shares.orderBy("wait_type").collect()] == [0.0811, 0.2162, 0.1622, 0.5405]


def test_top3_by_name_and_by_time(wait_store):
    by_name = reports.top3_waits(wait_store, ts(5), HOUR)
    assert rows(by_name, "time_date", "wait_type", "r") == [
        ("04:00:00", "a", 1), ("04:00:00", "b", 2), ("04:00:00", "c", 3), ("05:00:00", "a", 1), ("05:00:00", "d", 2),
    ]
    by_time = reports.top3_waits(wait_store, ts(5), HOUR, order_by="wait_time_ms")
    assert rows(by_time, "time_date", "wait_type", "r") == [
        ("04:00:00", "b", 1), ("04:00:00", "c", 2), ("04:00:00", "d", 3), ("05:00:00", "a", 2), ("05:00:00", "d", 1),
    ]
    with pytest.raises(ValueError):
        reports.top3_waits(wait_store, ts(5), HOUR, order_by="r")


def test_wait_time_per_interval_and_moving_averages(wait_store):
    frame = reports.wait_time_per_interval(wait_store, ts(5), HOUR)
    assert rows(frame) == [("04:00:00", 100, 10), ("05:00:00", 85, 2)]
    waits = charts.moving_average(frame, "time_date", "total_wait_time")
    assert rows(waits, "time_date", "moving_avg") == [("04:00:00", 100.0), ("05:00:00", 92.5)]
    tasks = charts.moving_average(frame, "time_date", "waiting_tasks", start_from_first=False)
    assert rows(tasks, "time_date", "moving_avg") == [("04:00:00", None), ("05:00:00", 6.0)]
    assert rows(reports.wait_time_per_interval(wait_store, ts(5), HOUR, limit=1), "time_date") == [("04:00:00",)]


def test_reports_on_an_empty_store(spark):
    store = b.store(spark)
    for report in (reports.top_avg_duration, reports.worker_time, reports.io, reports.top_waits, reports.top3_waits):
        assert report(store, ts(5)).count() == 0
    assert reports.excluded_count(store).first()[0] == 0
