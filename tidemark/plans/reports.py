"""The report datasets: ``name(store, as_of, lookback, ...) -> DataFrame``.

Facts are aggregated before they meet a dimension wherever the aggregation key
allows it, so what is joined has one row per query rather than one per query
and interval.  Exclusion and existence tests on the key commute with the
aggregation.

A fact without a following snapshot holds lifetime counters.  Reports count it
like any other, as they always have; with ``strict`` they leave it out.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arithmetic import int_avg
from tidemark.functions.times import at, time_label
from tidemark.operators.intervals import closed_within
from tidemark.operators.relational import drop_listed, keep_listed, top_k_per_group, top_n
from tidemark.store import Store

HOUR = timedelta(hours=1)
EIGHT_HOURS = timedelta(hours=8)
TOP = 10
TOP_PER_INTERVAL = 3

BUCKETS = ("label", "timestamp")


def not_excluded(df: DataFrame, store: Store, key: str = "query_id") -> DataFrame:
    """Rows of queries that are not on the exclusion list."""
    return drop_listed(df, store.excluded_queries, key)


def not_filtered_wait(waits: DataFrame, store: Store) -> DataFrame:
    """Wait rows whose type is not filtered out; types are compared without regard to case."""
    folded = waits.withColumn("_type", F.lower("wait_type"))
    return drop_listed(folded, store.wait_type_filter.select(F.lower("wait_type").alias("_type")), "_type").drop("_type")


def active_only(runtime: DataFrame) -> DataFrame:
    """Runtime rows with at least one execution; steps back after an eviction count as none."""
    return runtime.filter(F.col("execution_count") > 0)


def differences_only(facts: DataFrame, strict: bool) -> DataFrame:
    """With ``strict`` the rows that hold what happened in their interval, without lifetime counters."""
    return facts.filter("is_delta") if strict else facts


def _recent_runtime(store: Store, as_of: datetime, lookback: timedelta, strict: bool) -> DataFrame:
    runtime = active_only(differences_only(store.query_runtime_stats, strict))
    return closed_within(runtime, store.intervals, as_of, lookback)


def _recent_waits(store: Store, as_of: datetime, lookback: timedelta, strict: bool) -> DataFrame:
    waits = not_filtered_wait(differences_only(store.wait_stats, strict), store)
    return closed_within(waits, store.intervals, as_of, lookback)


def _bucket(bucket: str) -> Column:
    """Time column of a report: time of day (days merge) or the full timestamp."""
    if bucket not in BUCKETS:
        raise ValueError(f"bucket must be one of {BUCKETS}")
    end = F.col("interval_end")
    return (time_label(end) if bucket == "label" else end).alias("time_date")


def _per_known_query(
    store: Store, as_of: datetime, lookback: timedelta, measure: Column, strict: bool
) -> DataFrame:
    """One measure per query that still exists and is not excluded."""
    folded = _recent_runtime(store, as_of, lookback, strict).groupBy("query_id").agg(measure)
    return keep_listed(not_excluded(folded, store), store.queries, "query_id")


def top_avg_duration(
    store: Store, as_of: datetime, lookback: timedelta = HOUR, limit: int | None = TOP, strict: bool = False
) -> DataFrame:
    """Queries with the longest mean duration (mean of the interval averages)."""
    measure = int_avg(F.col("avg_elapsed_time")).alias("avg_elapsed_time")
    rows = _per_known_query(store, as_of, lookback, measure, strict)
    return top_n(
        rows.select("avg_elapsed_time", "query_id"),
        [F.desc("avg_elapsed_time"), F.asc("query_id")],
        limit,
    )


def top_executions(
    store: Store, as_of: datetime, lookback: timedelta = HOUR, limit: int | None = TOP, strict: bool = False
) -> DataFrame:
    """Queries executed most often."""
    measure = F.sum("execution_count").alias("count_exec")
    rows = _per_known_query(store, as_of, lookback, measure, strict)
    return top_n(
        rows.select("count_exec", "query_id"), [F.desc("count_exec"), F.asc("query_id")], limit
    )


def distinct_queries(store: Store, as_of: datetime, lookback: timedelta = HOUR) -> DataFrame:
    """How many queries share each exact last-execution time, labelled by time of day.

    Grouping is on the full timestamp, so a label can occur more than once.
    """
    recent = store.query_runtime_stats.filter(F.col("last_execution_time") >= at(as_of - lookback))
    seen = recent.select("query_id", "last_execution_time").distinct()
    counted = (
        not_excluded(seen, store)
        .groupBy("last_execution_time")
        .agg(F.count("query_id").alias("distinct_queries"))
    )
    return counted.select(
        time_label(F.col("last_execution_time")).alias("time_date"), "distinct_queries"
    ).orderBy("time_date")


def plan_variety(store: Store) -> DataFrame:
    """Plans by kind of object, over all time."""
    return store.plans.groupBy("plan_objecttype").agg(F.count("plan_id").alias("plan_count"))


def _query_databases(store: Store) -> DataFrame:
    """``(query_id, database_name)`` of every query that has a plan."""
    plans = store.plans.select("plan_id", F.col("plan_database").alias("database_name"))
    queries = not_excluded(store.queries, store).select("query_id", "plan_id")
    return queries.join(plans, "plan_id").select("query_id", "database_name")


def _by_time_and_database(
    store: Store,
    as_of: datetime,
    lookback: timedelta,
    measures: list[str],
    bucket: str,
    strict: bool,
) -> DataFrame:
    recent = _recent_runtime(store, as_of, lookback, strict).select("query_id", "interval_end", *measures)
    return (
        recent.join(_query_databases(store), "query_id")
        .groupBy(_bucket(bucket), "database_name")
        .agg(*[F.sum(m).alias(m) for m in measures])
        .orderBy("time_date", "database_name")
    )


def worker_time(
    store: Store, as_of: datetime, lookback: timedelta = EIGHT_HOURS, bucket: str = "label", strict: bool = False
) -> DataFrame:
    """Sum of average worker times by time and database."""
    return _by_time_and_database(store, as_of, lookback, ["avg_worker_time"], bucket, strict)


def io(
    store: Store, as_of: datetime, lookback: timedelta = HOUR, bucket: str = "label", strict: bool = False
) -> DataFrame:
    """Sums of average logical reads and writes by time and database.

    The look-back defaults to the one hour the report has always used; pass
    ``EIGHT_HOURS`` for the period its title promises.
    """
    measures = ["avg_logical_reads", "avg_logical_writes"]
    return _by_time_and_database(store, as_of, lookback, measures, bucket, strict)


def elapsed_time(
    store: Store, as_of: datetime, lookback: timedelta = EIGHT_HOURS, bucket: str = "label", strict: bool = False
) -> DataFrame:
    """Sum of average durations by time and database."""
    return _by_time_and_database(store, as_of, lookback, ["avg_elapsed_time"], bucket, strict)


def item_count(store: Store) -> DataFrame:
    """How many queries, plans and runtime rows each database has, plus two totals.

    Runtime rows are counted per query first, so the joins and the distinct
    counts see one row per query.
    """
    per_query = store.query_runtime_stats.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("_rows")
    )
    plans = store.plans.select("plan_id", F.col("plan_database").alias("database"))
    counted = (
        store.queries.select("query_id", "plan_id")
        .join(per_query, "query_id")
        .join(plans, "plan_id")
        .groupBy("database")
        .agg(
            F.count_distinct("query_id").alias("queries"),
            F.count_distinct("plan_id").alias("plans"),
            F.sum("_rows").alias("runtime_stats"),
        )
    )
    intervals = store.intervals.agg(F.count("interval_id")).scalar()
    waits = store.wait_stats.agg(F.count("wait_type")).scalar()
    return counted.select(
        "database",
        "queries",
        "plans",
        intervals.alias("intervals"),
        "runtime_stats",
        waits.alias("wait_stats"),
    )


def storage_size(catalog: DataFrame) -> DataFrame:
    """KB by table for tables with storage, out of a ``table_catalog`` frame."""
    return catalog.filter(F.col("size_kb").isNotNull()).select("table_name", "size_kb")


def last_log(store: Store) -> DataFrame:
    """All messages of the latest run."""
    latest = store.activity_log.agg(F.max("log_run_id")).scalar()
    return store.activity_log.filter(F.col("log_run_id") == latest).select(
        "log_id", "log_run_id", "log_timestamp", "log_message"
    )


def multiple_plans(store: Store, same_db: bool = False) -> DataFrame:
    """Plans of query shapes that occur more than once in a database.

    Exclusions count only while shapes are selected.  The plans are then found
    by shape alone, so those of other databases show up under each selected
    database; ``same_db`` keeps them to their own.  ``query_id`` is the
    smallest id with the shape.
    """
    plans = store.plans.select("plan_id", "plan_database")
    queries = store.queries.select("query_id", "plan_id", "query_hash").join(plans, "plan_id")
    repeated = (
        not_excluded(queries, store)
        .groupBy("query_hash", F.col("plan_database").alias("query_database"))
        .agg(F.count("query_id").alias("_n"))
        .filter("_n > 1")
    )
    first = store.queries.groupBy("query_hash").agg(F.min("query_id").alias("query_id"))
    shapes = repeated.join(first, "query_hash").select("query_hash", "query_database", "query_id")
    members = queries.select("query_hash", "plan_id", "plan_database")
    if same_db:
        members = members.withColumnRenamed("plan_database", "query_database")
        found = members.join(shapes, ["query_hash", "query_database"])
    else:
        found = members.join(shapes, "query_hash")
    return found.select("query_database", "query_id", "plan_id")


def excluded_count(store: Store) -> DataFrame:
    """Size of the exclusion list."""
    return store.excluded_queries.agg(F.count(F.lit(1)).alias("excluded_query_count"))


def top_waits(
    store: Store, as_of: datetime, lookback: timedelta = HOUR, limit: int | None = TOP, strict: bool = False
) -> DataFrame:
    """Wait types with the longest total wait."""
    rows = (
        _recent_waits(store, as_of, lookback, strict)
        .groupBy("wait_type")
        .agg(F.sum("wait_time_ms").alias("total_wait_time"))
    )
    return top_n(rows, [F.desc("total_wait_time"), F.asc("wait_type")], limit)


def top3_waits(
    store: Store,
    as_of: datetime,
    lookback: timedelta = HOUR,
    k: int = TOP_PER_INTERVAL,
    order_by: str = "wait_type",
    strict: bool = False,
) -> DataFrame:
    """``k`` wait types of each interval.

    The default takes the first by name, as the dataset does in spite of its
    title; ``order_by="wait_time_ms"`` takes the longest.
    """
    orders = {
        "wait_type": [F.asc("wait_type")],
        "wait_time_ms": [F.desc("wait_time_ms"), F.asc("wait_type")],
    }
    if order_by not in orders:
        raise ValueError(f"order_by must be one of {tuple(orders)}")
    rows = _recent_waits(store, as_of, lookback, strict).select(
        "interval_id", "interval_end", "wait_type", "wait_time_ms"
    )
    ranked = top_k_per_group(rows, ["interval_id"], orders[order_by], k)
    return ranked.select(
        time_label(F.col("interval_end")).alias("time_date"),
        "wait_type",
        "wait_time_ms",
        F.col("r").cast("long").alias("r"),
    )


def wait_time_per_interval(
    store: Store,
    as_of: datetime,
    lookback: timedelta = HOUR,
    limit: int | None = TOP,
    bucket: str = "label",
    strict: bool = False,
) -> DataFrame:
    """Total wait time and number of waits by time; the earliest labels if limited."""
    rows = (
        _recent_waits(store, as_of, lookback, strict)
        .groupBy(_bucket(bucket))
        .agg(
            F.sum("wait_time_ms").alias("total_wait_time"),
            F.sum("waiting_tasks_count").alias("waiting_tasks"),
        )
    )
    return top_n(rows, [F.asc("time_date")], limit)


def wait_filter_count(store: Store) -> DataFrame:
    """Number of filtered wait types."""
    return store.wait_type_filter.agg(F.count(F.lit(1)).alias("wait_type_filter_count"))
