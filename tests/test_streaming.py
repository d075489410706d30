"""The streaming forms against their batch counterparts, over the test tables."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests import builders as b
from tests.conftest import rows, ts
from tidemark.operators.deltas import runtime_delta, wait_delta
from tidemark.operators.snapshots import wait_snapshot
from tidemark.schemas import SNAPSHOTS
from tidemark.sources.tables import create_store, read_store
from tidemark.sources.workload import Workload
from tidemark.streaming.deltas import stream_delta, stream_wait_delta
from tidemark.streaming.publish import (
    append_batches, publish_differences, publish_intervals, read_landed, read_snapshots,
)
from tidemark.streaming.totals import interval_totals

SF = "/root/testdata/sf0.001"


def run(stream, tmp_path, name, **options):
    """Run a stream to its end into Parquet files and read them."""
    out = str(tmp_path / name)
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", str(tmp_path / f"{name}-state"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(300)
    assert query.exception() is None
    return stream.sparkSession.read.parquet(out)


def land(df, path, name, *groups):
    """One file per group of intervals."""
    for i, (first, last) in enumerate(groups):
        part = df.filter(F.col("interval_id").between(first, last)).select(*SNAPSHOTS[name].names)
        part.coalesce(1).write.parquet(f"{path}/part={i}")
    return f"{path}/*"


@pytest.fixture(scope="module")
def workload(spark):
    return Workload(spark, SF)


def test_stream_delta_equals_batch(spark, workload, tmp_path):
    snap = workload.runtime_snapshots().filter(F.col("interval_id").between(600, 720)).persist()
    path = land(snap, str(tmp_path / "in"), "query_runtime_stats", (600, 640), (641, 641), (642, 720))
    stream = stream_delta(read_snapshots(spark, path, "query_runtime_stats", 1))
    got = run(stream, tmp_path, "out")
    batch = runtime_delta(snap)
    newest = snap.groupBy("query_id").agg(F.max("interval_id").alias("interval_id"))
    expected = batch.join(newest, ["query_id", "interval_id"], "left_anti")
    assert got.count() > 1000
    assert rows(got, *expected.columns) == rows(expected, *expected.columns)
    snap.unpersist()


def test_stream_delta_gaps_late_and_unsorted_rows(spark, tmp_path):
    folder = str(tmp_path / "in")
    for i, data in enumerate(
        [[(1, 3, 7, 70), (1, 2, 5, 50)], [(1, 2, 99, 99), (1, 4, 9, 90)], [(1, 6, 11, 110)], [(1, 7, 5, 50)]]
    ):
        b.runtime(spark, data).coalesce(1).write.parquet(f"{folder}/part={i}")
    stream = stream_delta(read_snapshots(spark, f"{folder}/*", "query_runtime_stats", 1))
    got = run(stream, tmp_path, "out")
    assert rows(got, "interval_id", "execution_count", "total_rows", "avg_rows", "is_delta") == [
        (2, 2, 20, 10, True), (2, 99, 99, 0, False), (3, 2, 20, 10, True), (4, 9, 90, 0, False), (6, -6, -60, 10, True),
    ]


def test_stream_delta_takes_an_interval_once(spark, tmp_path):
    """A snapshot repeated within one micro-batch is a repetition too."""
    folder = str(tmp_path / "in")
    b.runtime(spark, [(1, 1, 2, 20), (1, 2, 5, 50), (1, 2, 5, 50), (1, 3, 7, 70)]).coalesce(1).write.parquet(folder)
    got = run(stream_delta(read_snapshots(spark, folder, "query_runtime_stats")), tmp_path, "out")
    assert rows(got, "interval_id", "execution_count", "is_delta") == [(1, 3, True), (2, 2, True)]


RUNTIME_BATCHES = [
    [(1, 2, 5, 50), (1, 3, 7, 70), (1, 3, 7, 70), (2, 3, 4, 40)],
    [(1, 4, 9, 90), (2, 1, 1, 10)],  # the second is late and has no successor
    [(1, 3, 7, 70), (1, 4, 9, 90), (2, 2, 3, 30)],  # repetitions, and a late one between two others
    [(1, 6, 11, 110)],
    [(1, 7, 5, 50), (2, 4, 6, 60)],
]


@pytest.mark.parametrize("twice", [False, True])
def test_snapshots_are_stored_as_differences(spark, tmp_path, twice):
    root = str(tmp_path / "store")
    create_store(spark, root)
    land_batch = publish_differences(root, "query_runtime_stats")
    for i, data in enumerate(RUNTIME_BATCHES):
        for _ in range(1 + twice):
            land_batch(b.runtime(spark, data), i)
    whole = b.runtime(spark, sorted({x for data in RUNTIME_BATCHES for x in data}))
    got, expected = read_store(spark, root).query_runtime_stats, runtime_delta(whole)
    assert rows(got, *expected.columns) == rows(expected, *expected.columns)


def test_waits_are_stored_as_differences(spark, tmp_path):
    """Intervals without new waits leave no row, also when their batch is repeated."""
    root = str(tmp_path / "store")
    create_store(spark, root)
    batches = [
        [(1, "a", 1, 1), (2, "a", 1, 1), (3, "a", 1, 1), (3, "b", 2, 2)],
        [(4, "a", 5, 9), (4, "b", 2, 2)],
        [(5, "a", 5, 9), (5, "b", 8, 8), (6, "b", 8, 8), (7, "b", 9, 9)],
    ]
    land_batch = publish_differences(root, "wait_stats")
    for i, data in enumerate(batches):
        for _ in range(2):
            land_batch(b.waits(spark, data), i)
    expected = wait_delta(b.waits(spark, [x for data in batches for x in data]))
    got = read_store(spark, root).wait_stats
    assert rows(got, *expected.columns) == rows(expected, *expected.columns)


def test_landing_differences_runs_no_python(spark, tmp_path):
    """Every plan of a batch stays in the JVM."""
    seen = []
    root = str(tmp_path / "store")
    create_store(spark, root)
    folder = str(tmp_path / "in")
    b.runtime(spark, [(1, 1, 2, 20), (1, 2, 5, 50)]).write.parquet(folder)

    def land_and_look(batch, batch_id):
        publish_differences(root, "query_runtime_stats")(batch, batch_id)
        seen.append(batch._jdf.queryExecution().executedPlan().toString())

    deliver(read_snapshots(spark, folder, "query_runtime_stats"), land_and_look, tmp_path, "state")
    assert seen and "Python" not in seen[0] and "Pandas" not in seen[0]
    assert rows(read_store(spark, root).query_runtime_stats, "interval_id", "execution_count", "is_delta") == [(1, 3, True), (2, 5, False)]


def test_stream_wait_delta_equals_batch(spark, workload, tmp_path):
    snap = wait_snapshot(workload.wait_counters()).filter("interval_id > 690").persist()
    path = land(snap, str(tmp_path / "in"), "wait_stats", (691, 700), (701, 720))
    got = run(stream_wait_delta(read_snapshots(spark, path, "wait_stats", 1)), tmp_path, "out")
    expected = wait_delta(snap, strict=True)
    assert rows(got, *expected.columns) == rows(expected, *expected.columns)
    snap.unpersist()


def test_interval_totals_emit_closed_hours(spark, workload, tmp_path):
    events = workload.table("events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    got = run(interval_totals(stream, "ts", {"total": "user_id"}, ["event_type"]), tmp_path, "out")
    newest = events.agg(F.max("ts")).first()[0] - timedelta(hours=1)
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    expected = (
        events.groupBy(hour.alias("interval_start"), "event_type")
        .agg(F.count("*").alias("events"), F.sum("user_id").alias("total"))
        .filter(F.col("interval_start") + F.expr("interval 1 hour") <= F.lit(newest.isoformat(" ")).cast("timestamp_ntz"))
    )
    shown = ("interval_start", "event_type", "events", "total")
    assert got.count() > 500
    assert rows(got, *shown) == rows(expected, *shown)


def deliver(stream, function, tmp_path, name):
    query = (
        stream.writeStream.foreachBatch(function)
        .option("checkpointLocation", str(tmp_path / name))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(300)
    assert query.exception() is None


def test_repeated_delivery_lands_nothing_twice(spark, tmp_path):
    data = b.waits(spark, [(i, w, i, i) for i in range(1, 5) for w in "ab"])
    path = land(data, str(tmp_path / "in"), "wait_stats", (1, 2), (3, 4))
    root = str(tmp_path / "landed")
    for attempt in ("first", "second"):
        stream = read_snapshots(spark, path, "wait_stats", 1)
        deliver(stream, append_batches(root, "wait_stats"), tmp_path, attempt)
        assert rows(read_landed(spark, root, "wait_stats")) == rows(data)


def test_publish_intervals_merges_by_key(spark, tmp_path):
    root = str(tmp_path / "store")
    create_store(spark, root, wait_stats=b.waits(spark, [(0, "old", 1, 1), (1, "stays", 1, 1), (1, "a", 9, 9)]))
    data = b.waits(spark, [(i, w, i, i) for i in range(1, 5) for w in "ab"])
    path = land(data, str(tmp_path / "in"), "wait_stats", (1, 2), (3, 4))
    for attempt in ("first", "second"):
        stream = read_snapshots(spark, path, "wait_stats", 1)
        deliver(stream, publish_intervals(root, "wait_stats"), tmp_path, attempt)
        got = rows(read_store(spark, root).wait_stats, *data.columns)
        assert got == sorted([*rows(data), (0, "old", 1, 1, 1, 1), (1, "stays", 1, 1, 1, 1)], key=repr)


def test_an_interval_may_come_in_several_batches(spark, tmp_path):
    root = str(tmp_path / "store")
    create_store(spark, root)
    folder = str(tmp_path / "in")
    for i, data in enumerate([[(9, "a", 1, 1), (9, "b", 1, 1)], [(9, "c", 1, 1), (9, "a", 2, 2)]]):
        b.waits(spark, data).coalesce(1).write.parquet(f"{folder}/part={i}")
    deliver(read_snapshots(spark, f"{folder}/*", "wait_stats", 1), publish_intervals(root, "wait_stats"), tmp_path, "state")
    got = rows(read_store(spark, root).wait_stats, "wait_type", "waiting_tasks_count")
    assert [w for w, _ in got] == ["a", "b", "c"]


def test_of_two_rows_of_a_key_the_same_is_taken_however_they_come(spark, tmp_path):
    taken = set()
    for i, data in enumerate([[(9, "a", 1, 1), (9, "a", 2, 2)], [(9, "a", 2, 2), (9, "a", 1, 1)]]):
        root = str(tmp_path / f"store{i}")
        create_store(spark, root)
        publish_intervals(root, "wait_stats")(b.waits(spark, data).coalesce(1), 0)
        taken.update(rows(read_store(spark, root).wait_stats, "waiting_tasks_count"))
    assert taken == {(2,)}


def test_publish_keeps_time_zone_free_timestamps(spark, tmp_path):
    root = str(tmp_path / "store")
    store = create_store(spark, root, query_runtime_stats=b.runtime(spark, [(1, 1, 1, 1, ts(2, 30))]))
    assert rows(store.query_runtime_stats, "last_execution_time") == [(ts(2, 30),)]


def test_keys_that_share_a_call_do_not_mix(spark, tmp_path):
    """Three neighbouring keys, one far away and none: late rows, gaps and repetitions of one are not the others'."""
    batches = [
        [(1, 3, 7, 70), (1, 2, 5, 50), (2, 2, 1, 10), (None, 2, 4, 40), (900, 1, 1, 10)],
        [(1, 2, 99, 99), (2, 3, 4, 40), (2, 3, 4, 40), (3, 9, 2, 20), (None, 3, 6, 60)],
        [(1, 4, 9, 90), (2, 5, 8, 80), (3, 10, 5, 50), (900, 2, 3, 30), (-1, 1, 1, 10)],
        [(-1, 2, 3, 30), (3, 8, 1, 10)],
    ]
    folder = str(tmp_path / "in")
    for i, data in enumerate(batches):
        b.runtime(spark, data).coalesce(1).write.parquet(f"{folder}/part={i}")
    got = run(stream_delta(read_snapshots(spark, f"{folder}/*", "query_runtime_stats", 1)), tmp_path, "out")
    assert rows(got, "query_id", "interval_id", "execution_count", "avg_rows", "is_delta") == sorted([
        (1, 2, 2, 10, True), (1, 2, 99, 0, False), (1, 3, 2, 10, True), (2, 2, 3, 10, True), (2, 3, 4, 0, False),
        (None, 2, 2, 10, True), (3, 9, 3, 10, True), (3, 8, 1, 0, False), (900, 1, 2, 10, True), (-1, 1, 2, 10, True),
    ], key=repr)


def test_neighbouring_keys_share_a_call(spark, tmp_path):
    folder = str(tmp_path / "in")
    b.runtime(spark, [(q, 1, 1, 1) for q in range(64)]).write.parquet(folder)
    stream = stream_delta(read_snapshots(spark, folder, "query_runtime_stats"))
    writer = stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
    query = writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert states and max(states) == 4


def test_a_landed_batch_leaves_no_intermediate_rows(spark, tmp_path):
    from pathlib import Path

    from tidemark.sources.tables import shared_folder

    root = str(tmp_path / "store")
    create_store(spark, root)
    shared = Path(shared_folder(spark).removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for f in shared.rglob("*") if f.is_file())
    before = size()
    data = b.runtime(spark, [(q, i, q + i, q * i) for q in range(300) for i in range(1, 9)])
    publish_differences(root, "query_runtime_stats")(data, 0)
    assert size() - before < 20_000  # less than a tenth of the rows as they are
    assert read_store(spark, root).query_runtime_stats.count() == 2400


SLICED = {
    "query_runtime_stats": [
        [(1, 2, 5, 50), (1, 3, 7, 70), (1, 3, 7, 70), (2, 3, 4, 40), (None, 3, 1, 10), (None, 4, 2, 20), (1, 8, 20, 200)],
        # After a gap, late, repeated, and with other counters than are stored (1, 3 and 1, 8).
        [(1, 3, 8, 80), (1, 4, 9, 90), (1, 5, 9, 90), (1, 7, 12, 120), (1, 8, 30, 300), (2, 1, 1, 10), (2, 2, 3, 30), (2, 9, 9, 90)],
        [(2, 4, 6, 60), (1, 6, 11, 110), (1, 9, 40, 400), (2, 8, 8, 80), (1, 12, 50, 500)],
    ],
    "wait_stats": [
        [(1, "a", 1, 1), (2, "a", 1, 1), (3, "a", 1, 1), (3, "b", 2, 2), (8, "a", 4, 4)],
        [(4, "a", 5, 9), (4, "b", 2, 2), (5, "b", 2, 2), (7, "a", 5, 9), (8, "a", 5, 9), (9, "b", 3, 3)],
        [(5, "a", 5, 9), (5, "b", 8, 8), (6, "b", 8, 8), (7, "b", 9, 9), (10, "b", 9, 9)],
    ],
}


@pytest.mark.parametrize("name", SLICED)
def test_slices_of_a_batch_change_no_result(spark, tmp_path, monkeypatch, name):
    """A batch that is stored in four slices leaves what it leaves if it is stored at once."""
    from tidemark.streaming import publish

    make = {"query_runtime_stats": b.runtime, "wait_stats": b.waits}[name]
    stored, got = [], {}
    replace = publish.replace_intervals
    monkeypatch.setattr(publish, "replace_intervals", lambda df, root, *more: (stored.append((root, df.count())), replace(df, root, *more)))
    monkeypatch.setattr(publish, "SLICES", 4, raising=False)
    for least in (1_000_000, 1):
        monkeypatch.setattr(publish, "ROWS_PER_SLICE", least, raising=False)
        root = str(tmp_path / f"store{least}")
        create_store(spark, root)
        land_batch = publish_differences(root, name)
        for i, data in enumerate(SLICED[name]):
            for _ in range(1 + (i == 1)):
                land_batch(make(spark, data), i)
        got[root] = rows(read_store(spark, root).tables()[name])
    whole, sliced = got
    assert got[sliced] == got[whole] and len(got[whole]) > 5
    assert max(n for root, n in stored if root == sliced) < max(n for root, n in stored if root == whole)


def test_slices_have_about_the_same_number_of_rows(monkeypatch):
    from tidemark.streaming import publish

    monkeypatch.setattr(publish, "ROWS_PER_SLICE", 100)
    counts = {i: 10 for i in range(1, 101)} | {None: 10}
    assert publish.slice_bounds(counts) == [11, 21, 31, 41, 51, 61, 71, 81, 91]
    assert publish.slice_bounds({1: 99, 2: 100}) == [] and publish.slice_bounds({5: 1000, 6: 1, 7: 1}) == [6, 7]
    assert len(publish.slice_bounds({i: 100 for i in range(1000)})) == publish.SLICES - 1
    assert publish.slice_bounds({None: 1000}) == []


def test_a_landed_batch_leaves_no_shuffle_files(spark, tmp_path):
    import time

    root = str(tmp_path / "store")
    create_store(spark, root)
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    data = b.runtime(spark, [(q, i, q + i, q * i) for q in range(50) for i in range(1, 9)])
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, before = spark.conf.get(cleanup), shuffled()
    publish_differences(root, "query_runtime_stats")(data, 0)
    end = time.time() + 10
    while (left := shuffled() - before) and time.time() < end:  # Spark removes them in the background
        time.sleep(0.1)
    assert not left and spark.conf.get(cleanup) == setting
    assert read_store(spark, root).query_runtime_stats.count() == 400
