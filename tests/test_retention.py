import pytest

from pyspark.sql import DataFrameReader
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests import builders as b
from tests.conftest import rows, ts
from tidemark.schemas import QUERY_RUNTIME_STATS, STORE_TABLES
from tidemark.sources.cleanup import cleanup
from tidemark.sources.tables import append_rows, compact, read_store, read_table, write_store
from tidemark.operators.retention import exclude_query, purge, retention, retention_candidates


@pytest.fixture(scope="module")
def store(spark):
    """'Now' is the 10th; with 5 days kept, the cutoff is midnight of the 5th."""
    facts = b.runtime(
        spark,
        [
            (1, 1, 1, 1, ts(day=1)), (1, 2, 1, 1, ts(day=9)),
            (2, 1, 1, 1, ts(day=2)), (2, 2, 1, 1, ts(day=3)),
            (3, 1, 1, 1, ts(day=4)),
            (4, 1, 1, 1, ts(day=5)),
            (4, 3, 1, 1, ts(day=5)),
            (8, 1, 1, 1, ts(day=1)),
        ],
    )
    return b.store(
        spark,
        query_runtime_stats=facts,
        queries=b.queries(spark, [(1, 10, b"a"), (2, 10, b"a"), (3, 11, b"a"), (4, 12, b"a"), (5, 13, b"a")]),
        plans=b.plans(spark, [(10, "x", "A"), (11, "x", "A"), (12, "x", "A"), (13, "x", "A"), (14, "x", "A")]),
        intervals=b.frame(
            spark,
            "intervals",
            [(1, ts(day=1), ts(day=2)), (2, ts(day=2), None), (3, ts(day=3), ts(day=4)), (4, ts(day=4), ts(day=6)), (5, ts(day=6), None)],
        ),
        wait_stats=b.waits(spark, [(i, w, 1, 1) for i in range(1, 6) for w in "ab"]),
        activity_log=b.frame(spark, "activity_log", [(i, i, ts(day=i + 2), "m") for i in range(1, 6)]),
    )


def complete(df, name):
    """A frame with the columns of a store table it lacks as NULLs."""
    return df.select(
        *[
            F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in STORE_TABLES[name].fields
        ]
    )


def shape(s):
    return (
        rows(s.query_runtime_stats, "query_id", "interval_id"),
        rows(s.queries, "query_id"),
        rows(s.plans, "plan_id"),
        rows(s.wait_stats, "interval_id", "wait_type"),
        rows(s.activity_log, "log_id"),
    )


def test_candidates_must_still_exist(store):
    got = retention_candidates(store.query_runtime_stats, store.queries, ts(day=5))
    assert rows(got) == [(2, 10), (3, 11)]


def test_cascade(store):
    kept = retention(store, ts(day=10), 5)
    runtime, queries, plans, waits, log = shape(kept)
    assert runtime == [(1, 1), (1, 2), (4, 1), (4, 3), (8, 1)]
    assert queries == [(1,), (4,), (5,)]
    # Plan 10 still has query 1; plan 14 never had one but belongs to no candidate.
    assert plans == [(10,), (12,), (13,), (14,)]
    assert waits == [(4, "a"), (4, "b"), (5, "a"), (5, "b")]
    assert log == [(3,), (4,), (5,)]
    assert kept.intervals is store.intervals and kept.plan_dbid is store.plan_dbid


def test_twice_is_once(store):
    kept = retention(store, ts(day=10), 5)
    assert shape(retention(kept, ts(day=10), 5)) == shape(kept)


def test_nothing_expired_keeps_everything(store):
    assert shape(retention(store, ts(day=10), 255)) == shape(store)


def test_throttled_runs_end_where_one_without_a_limit_does(store):
    kept = retention(store, ts(day=10), 5, max_rows=1)
    runtime, queries, plans, waits, log = shape(kept)
    # One runtime row of query 2 goes; the query stays with its other row.
    assert (2, 1) not in runtime and (2, 2) in runtime and (3, 1) in runtime
    assert (2,) in queries and (11,) in {p for p in plans}
    assert len(waits) == 9 and len(log) == 4
    once = retention(store, ts(day=10), 5)
    for _ in range(2):
        kept = retention(kept, ts(day=10), 5, max_rows=100)
    assert shape(kept) == shape(once)


@pytest.mark.parametrize("max_rows", [None, 1])
def test_cleanup_of_stored_files_equals_retention(spark, store, tmp_path, max_rows):
    root = str(tmp_path / "store")
    full = store.with_frames(
        plans=complete(store.plans, "plans"), queries=complete(store.queries, "queries")
    )
    write_store(full, root)
    facts = lambda: {
        str(f) for n in ("query_runtime_stats", "wait_stats") for f in (tmp_path / "store" / n).rglob("*.parquet")
    }
    untouched = facts()
    got = cleanup(spark, root, ts(day=10), 5, max_rows)
    first = shape(got)
    assert first == shape(retention(store, ts(day=10), 5, max_rows))
    assert facts() == untouched
    assert not list((tmp_path / "store").glob("*__*"))
    again = cleanup(spark, root, ts(day=10), 255)
    assert shape(again) == first
    for name in ("query_runtime_stats", "wait_stats"):
        compact(spark, root, name)
        compact(spark, root, name)
    assert not list((tmp_path / "store").glob("expired_*")) and facts().isdisjoint(untouched)
    assert shape(read_store(spark, root)) == first


def test_ids_that_are_given_again_are_not_hidden(spark, store, tmp_path):
    root = str(tmp_path / "store")
    full = store.with_frames(
        plans=complete(store.plans, "plans"), queries=complete(store.queries, "queries")
    )
    write_store(full, root)
    cleanup(spark, root, ts(day=10), 5)
    append_rows(b.runtime(spark, [(3, 9, 1, 1, ts(day=10)), (2, 9, 1, 1, ts(day=10))]), root, "query_runtime_stats")
    append_rows(b.waits(spark, [(9, "a", 1, 1)]), root, "wait_stats")
    got = read_store(spark, root)
    assert {(2, 9), (3, 9)} < set(rows(got.query_runtime_stats, "query_id", "interval_id"))
    assert (9, "a") in rows(got.wait_stats, "interval_id", "wait_type")


def test_expired_wait_folders_stay_unread(spark, store, tmp_path):
    root = str(tmp_path / "store")
    full = store.with_frames(
        plans=complete(store.plans, "plans"), queries=complete(store.queries, "queries")
    )
    write_store(full, root)
    waits = cleanup(spark, root, ts(day=10), 5).wait_stats
    plan = waits._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "wait_time_ms" in line)
    assert "Subquery" in scan.split("PartitionFilters: [")[1].split("]")[0]


def test_cleanup_lists_and_reads_facts_once(spark, store, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    full = store.with_frames(
        plans=complete(store.plans, "plans"), queries=complete(store.queries, "queries")
    )
    write_store(full, root)
    listed, parquet = [], DataFrameReader.parquet

    def counted(reader, *paths, **options):
        listed.extend(path.rsplit("/", 1)[-1] for path in paths)
        return parquet(reader, *paths, **options)

    monkeypatch.setattr(DataFrameReader, "parquet", counted)
    cleanup(spark, root, ts(day=10), 5)
    assert listed.count("query_runtime_stats") == 1 and listed.count("wait_stats") == 1


def test_large_intervals_are_not_split_with_others(spark, tmp_path):
    """40 intervals in 2 shuffle partitions: few are split together, not all that share a partition."""
    counter = F.xxhash64("id")
    history = spark.range(0, 40_000, 1, 8).select(
        (F.col("id") % 1000).alias("query_id"),
        (F.col("id") % 40 + 1).cast("int").alias("interval_id"),
        *[counter.alias(f.name) if f.dataType == T.LongType() else F.lit(None).cast(f.dataType).alias(f.name)
          for f in QUERY_RUNTIME_STATS.fields[2:]],
    )
    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "80k", "spark.sql.shuffle.partitions": "2"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        append_rows(history, str(tmp_path), "query_runtime_stats")
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    files = list((tmp_path / "query_runtime_stats").rglob("*.parquet"))
    assert len(files) <= 120
    assert rows(read_table(spark, str(tmp_path), "query_runtime_stats"), *history.columns) == rows(history)


def test_purge_empties_history_only(spark, store):
    full = store.with_frames(
        excluded_queries=b.ids(spark, 1),
        wait_type_filter=b.wait_filter(spark, "w"),
        monitored_databases=spark.createDataFrame([("d",)], "database_name string"),
    )
    left = {name: df.count() for name, df in purge(full).tables().items()}
    assert {n for n, c in left.items() if c} == {"monitored_databases", "wait_type_filter"}
    assert len(left) == 10


def test_exclude_query_twice(spark):
    once = exclude_query(b.ids(spark, 1), 2)
    assert rows(exclude_query(once, 2)) == [(1,), (2,)]
