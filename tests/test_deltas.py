import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests import builders as b
from tests.conftest import rows, ts
from tidemark.operators.deltas import (
    RUNTIME_COUNTERS,
    runtime_delta,
    runtime_delta_step,
    wait_delta,
    wait_delta_step,
)
from tidemark.operators.intervals import closed_intervals, open_close_intervals
from tidemark.operators.relational import assign_ids, drop_listed, top_k_per_group
from tidemark.operators.snapshots import runtime_snapshot, wait_snapshot
from tidemark.schemas import METRICS

SHOWN = ("query_id", "interval_id", "execution_count", "total_elapsed_time", "avg_elapsed_time", "is_delta")


def test_differences_and_the_raw_newest_row(spark):
    snap = b.runtime(spark, [(1, 1, 2, 10), (1, 2, 5, 25), (1, 3, 5, 25)])
    assert rows(runtime_delta(snap), *SHOWN) == [
        (1, 1, 3, 15, 5, True),
        (1, 2, 0, 0, 0, True),
        (1, 3, 5, 25, 0, False),
    ]


def test_a_gap_leaves_the_row_before_it_raw(spark):
    snap = b.runtime(spark, [(1, 1, 2, 10), (1, 2, 5, 25), (1, 4, 9, 45)])
    assert rows(runtime_delta(snap), *SHOWN) == [
        (1, 1, 3, 15, 5, True),
        (1, 2, 5, 25, 0, False),
        (1, 4, 9, 45, 0, False),
    ]


RESETS = {"keep": (-3, -10, 3), "zero": (0, 0, 0), "null": (None, None, 0)}


@pytest.mark.parametrize("mode", RESETS)
def test_eviction_makes_steps_negative(spark, mode):
    snap = b.runtime(spark, [(1, 1, 5, 20), (1, 2, 2, 10)])
    count, total, average = RESETS[mode]
    first = runtime_delta(snap, on_reset=mode).filter("interval_id = 1").first()
    assert (first["execution_count"], first["total_rows"], first["avg_rows"]) == (count, total, average)


def test_negative_average_truncates_toward_zero(spark):
    snap = b.runtime(spark, [(1, 1, 5, 20), (1, 2, 7, 13)])
    assert runtime_delta(snap).filter("interval_id = 1").first()["avg_rows"] == -3


def test_min_max_last_and_times_are_not_differenced(spark):
    snap = b.runtime(spark, [(1, 1, 2, 10), (1, 2, 5, 25)])
    first = runtime_delta(snap).filter("interval_id = 1").first()
    for m in METRICS:
        assert (first[f"last_{m}"], first[f"min_{m}"], first[f"max_{m}"]) == (3, 1, 2)
    assert first["creation_time"] == ts() and first["last_execution_time"] == ts(0)


def test_strict_keeps_only_differences(spark):
    snap = b.runtime(spark, [(1, 1, 2, 10), (1, 2, 5, 25), (2, 2, 1, 1)])
    assert rows(runtime_delta(snap, strict=True), "query_id", "interval_id") == [(1, 1)]


def test_unknown_reset_mode(spark):
    with pytest.raises(ValueError):
        runtime_delta(b.runtime(spark, [(1, 1, 1, 1)]), on_reset="other")


def joined_delta(snap):
    """The definition: a self join on the following interval."""
    nxt = snap.select(
        "query_id",
        (F.col("interval_id") - 1).alias("interval_id"),
        F.lit(True).alias("has_next"),
        *[F.col(c).alias(f"n_{c}") for c in RUNTIME_COUNTERS],
    )
    pair = snap.join(nxt, ["query_id", "interval_id"], "left")
    return pair.select(
        "query_id",
        "interval_id",
        *[
            F.when(F.col("has_next"), F.col(f"n_{c}") - F.col(c)).otherwise(F.col(c)).alias(c)
            for c in RUNTIME_COUNTERS
        ],
    )


history = st.lists(
    st.tuples(st.integers(1, 3), st.integers(1, 9), st.integers(0, 20), st.integers(0, 99)),
    min_size=1,
    max_size=20,
    unique_by=lambda r: r[:2],
)


@settings(max_examples=8, deadline=None)
@given(history, st.sampled_from([1, 2, 3, 4, 1024]))
def test_window_form_equals_self_join_for_every_block_size(spark, data, block):
    snap = b.runtime(spark, data)
    columns = ["query_id", "interval_id", *RUNTIME_COUNTERS]
    assert rows(runtime_delta(snap, block=block), *columns) == rows(joined_delta(snap), *columns)


@settings(max_examples=5, deadline=None)
@given(history)
def test_strict_differences_of_a_contiguous_run_add_up(spark, data):
    counts = {(q, i): n for q, i, n, _ in data}
    got = runtime_delta(b.runtime(spark, data), strict=True).groupBy("query_id").agg(
        F.sum("execution_count").alias("n")
    )
    expected = {}
    for (q, i), n in counts.items():
        if (q, i + 1) in counts:
            expected[q] = expected.get(q, 0) + counts[q, i + 1] - n
    assert {r["query_id"]: r["n"] for r in got.collect()} == expected


def test_step_equals_the_history_form(spark):
    data = [(1, 4, 2, 10), (1, 5, 5, 25), (2, 4, 3, 9), (3, 5, 1, 1)]
    snap = b.runtime(spark, data)
    step = runtime_delta_step(snap.filter("interval_id = 4"), snap.filter("interval_id = 5"))
    whole = runtime_delta(snap).filter("interval_id = 4")
    assert rows(step, *whole.columns) == rows(whole, *whole.columns)


WAITS = [
    (1, "a", 2, 10), (2, "a", 5, 30),
    (1, "b", 4, 8), (2, "b", 4, 8),
    (1, "c", 9, 90), (2, "c", 3, 30),
    (1, "d", 1, 1),
]


def test_wait_delta_drops_idle_keeps_negative_and_raw(spark):
    got = rows(wait_delta(b.waits(spark, WAITS)), "wait_type", "interval_id", "waiting_tasks_count", "max_wait_time_ms")
    assert got == [
        ("a", 1, 3, 20),
        ("a", 2, 5, 30),
        ("b", 2, 4, 8),
        ("c", 1, -6, -60),
        ("c", 2, 3, 30),
        ("d", 1, 1, 1),
    ]


def test_wait_step_equals_history_form(spark):
    snap = b.waits(spark, WAITS)
    step = wait_delta_step(snap.filter("interval_id = 1"), snap.filter("interval_id = 2"))
    whole = wait_delta(snap).filter("interval_id = 1")
    assert rows(step, *whole.columns) == rows(whole, *whole.columns)


def test_wait_snapshot_needs_tasks_and_time(spark):
    raw = spark.createDataFrame(
        [("a", 1, 5, 5, 0), ("b", 0, 5, 5, 0), ("c", 1, 0, 0, 0)],
        "wait_type string, waiting_tasks_count long, wait_time_ms long, max_wait_time_ms long, signal_wait_time_ms long",
    )
    assert rows(wait_snapshot(raw, 7), "interval_id", "wait_type") == [(7, "a")]


def stats_row(hash_, start, end, created, handle, n, total):
    return (
        hash_, start, end, created, created, handle, n,
        *([total, total, n, total] * len(METRICS)), 1,
    )


STATS_SCHEMA = (
    "query_hash binary, statement_start_offset int, statement_end_offset int, creation_time timestamp_ntz, "
    "last_execution_time timestamp_ntz, plan_handle binary, execution_count long, "
    + ", ".join(f"{s}_{m} long" for m in METRICS for s in ("total", "last", "min", "max"))
    + ", interval_id int"
)


def snapshot_inputs(spark):
    stats = spark.createDataFrame(
        [
            stats_row(b"h", 0, -1, ts(1), b"p1", 2, 10),
            stats_row(b"h", 0, -1, ts(1), b"p2", 3, 5),
            stats_row(b"h", 0, -1, ts(2), b"p3", 7, 70),
            stats_row(b"h", 4, -1, ts(1), b"p1", 9, 90),
            stats_row(None, 0, -1, ts(1), b"p4", 9, 90),
        ],
        STATS_SCHEMA,
    )
    known = spark.createDataFrame(
        [(1, b"h", 0, -1, ts(1)), (2, None, 0, -1, ts(1))],
        "query_id long, query_hash binary, query_statement_start_offset int, "
        "query_statement_end_offset int, query_creation_time timestamp_ntz",
    )
    return known, stats


def test_snapshot_folds_the_handles_of_a_query(spark):
    got = runtime_snapshot(*snapshot_inputs(spark)).collect()
    assert len(got) == 1
    row = got[0]
    assert (row["query_id"], row["interval_id"], row["execution_count"]) == (1, 1, 5)
    assert (row["total_rows"], row["last_rows"], row["min_rows"], row["max_rows"], row["avg_rows"]) == (15, 15, 2, 10, 0)


def test_recompiled_statement_matches_only_without_creation_time(spark):
    got = runtime_snapshot(*snapshot_inputs(spark), match_creation_time=False).collect()
    assert [(r["query_id"], r["execution_count"]) for r in got] == [(1, 12)]


def test_intervals_close_when_the_next_run_starts(spark):
    runs = spark.createDataFrame([(1, ts(1)), (2, ts(2)), (4, ts(4))], "run_id int, run_time timestamp_ntz")
    assert rows(open_close_intervals(runs)) == [(1, ts(1), ts(2)), (2, ts(2), None), (4, ts(4), None)]


def test_closed_intervals_leave_out_open_and_newest(spark):
    from datetime import timedelta

    frame = b.frame(
        spark,
        "intervals",
        [(1, ts(0), ts(1)), (2, ts(1), ts(2)), (3, ts(2), None), (4, ts(3), ts(4))],
    )
    got = closed_intervals(frame, ts(4), timedelta(hours=2))
    assert rows(got, "interval_id") == [(2,)]


def test_drop_listed_ignores_nulls_in_the_list_and_drops_null_keys(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(2,), (None,)], "k int")
    assert rows(drop_listed(left, right, "k")) == [(1,)]


def test_top_k_per_group(spark):
    df = spark.createDataFrame([("x", v) for v in range(5)] + [("y", 1)], "g string, v int")
    assert rows(top_k_per_group(df, ["g"], [F.desc("v")], 2), "g", "v", "r") == [
        ("x", 3, 2), ("x", 4, 1), ("y", 1, 1),
    ]


@pytest.mark.parametrize("digits", [1, 3])
def test_assign_ids_is_dense_and_repeatable(spark, digits):
    df = spark.range(500).withColumn("k", F.col("id") % 7)
    first = assign_ids(df, "n", ["k", "id"], 40, digits)
    again = assign_ids(df.repartition(5), "n", ["k", "id"], 40, digits)
    assert rows(first, "n") == [(n,) for n in sorted(range(41, 541), key=lambda n: repr((n,)))]
    assert rows(first, "n", "id") == rows(again, "n", "id")


def test_assign_ids_with_an_empty_batch(spark):
    assert assign_ids(spark.range(0), "n", ["id"], 3).count() == 0
