"""Expiring history by last activity.

Nothing is deleted in place: each function gives the rows to keep or the rows
to remove, and the caller writes the kept rows to a new location.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import at
from tidemark.schemas import KEPT_ON_PURGE
from tidemark.store import Store


def cutoff(as_of: datetime, days: int) -> datetime:
    """History older than this may go."""
    return as_of - timedelta(days=days)


def retention_candidates(runtime: DataFrame, queries: DataFrame, before: datetime) -> DataFrame:
    """``(query_id, plan_id)`` of queries last executed before the cutoff."""
    expired = (
        runtime.groupBy("query_id")
        .agg(F.max("last_execution_time").alias("last_execution_time"))
        .filter(F.col("last_execution_time") < at(before))
    )
    return expired.join(queries.select("query_id", "plan_id"), "query_id").select(
        "query_id", "plan_id"
    )


def _first(df: DataFrame, keys: list[str], max_rows: int | None) -> DataFrame:
    """Keys of the rows one batch removes: all, or the first ``max_rows`` in key order."""
    picked = df.select(*keys)
    return picked if max_rows is None else picked.orderBy(*keys).limit(max_rows)


def expired_runtime(
    runtime: DataFrame, candidates: DataFrame, max_rows: int | None = None
) -> DataFrame:
    """Keys of the runtime rows to remove."""
    ids = candidates.select("query_id")
    rows = runtime.select("query_id", "interval_id").join(ids, "query_id", "left_semi")
    return _first(rows, ["query_id", "interval_id"], max_rows)


def keep_runtime(
    runtime: DataFrame, candidates: DataFrame, max_rows: int | None = None
) -> DataFrame:
    """Runtime rows that stay.  Without a limit whole queries go, with one anti join."""
    if max_rows is None:
        return runtime.join(candidates.select("query_id"), "query_id", "left_anti")
    gone = expired_runtime(runtime, candidates, max_rows)
    return runtime.join(gone, ["query_id", "interval_id"], "left_anti")


def without_runtime(
    candidates: DataFrame, kept_runtime: DataFrame, max_rows: int | None = None
) -> DataFrame:
    """Candidates that have no runtime row left; without a limit these are all."""
    if max_rows is None:
        return candidates
    return candidates.join(kept_runtime.select("query_id"), "query_id", "left_anti")


def keep_queries(
    queries: DataFrame, candidates: DataFrame, max_rows: int | None = None
) -> DataFrame:
    """Queries that stay."""
    gone = _first(candidates, ["query_id"], max_rows)
    return queries.join(gone, "query_id", "left_anti")


def expired_plans(
    plans: DataFrame, kept_queries: DataFrame, candidates: DataFrame, max_rows: int | None = None
) -> DataFrame:
    """Ids of the candidates' plans that no remaining query refers to."""
    orphaned = candidates.select("plan_id").join(kept_queries.select("plan_id"), "plan_id", "left_anti")
    stored = plans.select("plan_id").join(orphaned, "plan_id", "left_semi")
    return _first(stored, ["plan_id"], max_rows)


def keep_plans(
    plans: DataFrame, kept_queries: DataFrame, candidates: DataFrame, max_rows: int | None = None
) -> DataFrame:
    """Plans that stay."""
    gone = expired_plans(plans, kept_queries, candidates, max_rows)
    return plans.join(gone, "plan_id", "left_anti")


def newest_expired_interval(intervals: DataFrame, before: datetime) -> Column:
    """Largest id of an interval that ended before the cutoff, as a scalar expression."""
    ended = F.when(F.col("interval_end") < at(before), F.col("interval_id"))
    return intervals.agg(F.max(ended).alias("interval_id")).scalar()


def expired_waits(
    waits: DataFrame, intervals: DataFrame, before: datetime, max_rows: int | None = None
) -> DataFrame:
    """Keys of the wait rows to remove."""
    last = newest_expired_interval(intervals, before)
    return _first(waits.filter(F.col("interval_id") <= last), ["interval_id", "wait_type"], max_rows)


def keep_waits(
    waits: DataFrame, intervals: DataFrame, before: datetime, max_rows: int | None = None
) -> DataFrame:
    """Wait rows that stay.  On waits stored by interval this reads no expired folder."""
    if max_rows is None:
        last = newest_expired_interval(intervals, before)
        return waits.filter(F.coalesce(F.col("interval_id") > last, F.lit(True)))
    gone = expired_waits(waits, intervals, before, max_rows)
    return waits.join(gone, ["interval_id", "wait_type"], "left_anti")


def keep_log(log: DataFrame, before: datetime, max_rows: int | None = None) -> DataFrame:
    """Log rows that stay."""
    if max_rows is None:
        fresh = F.col("log_timestamp") >= at(before)
        return log.filter(F.coalesce(fresh, F.lit(True)))
    gone = _first(log.filter(F.col("log_timestamp") < at(before)), ["log_id"], max_rows)
    return log.join(gone, "log_id", "left_anti")


def retention(store: Store, as_of: datetime, days: int, max_rows: int | None = None) -> Store:
    """The store without expired history.

    Queries not executed within ``days`` lose their runtime rows, then
    themselves, then plans left without a query; log and waits expire by time.
    Intervals and the ledger of seen handles are kept.  ``max_rows`` bounds
    what each of these steps removes.  A query then goes with its last runtime
    row and not before, so repeated runs end where one without a bound does.
    """
    before = cutoff(as_of, days)
    candidates = retention_candidates(store.query_runtime_stats, store.queries, before)
    runtime = keep_runtime(store.query_runtime_stats, candidates, max_rows)
    candidates = without_runtime(candidates, runtime, max_rows)
    queries = keep_queries(store.queries, candidates, max_rows)
    return store.with_frames(
        activity_log=keep_log(store.activity_log, before, max_rows),
        query_runtime_stats=runtime,
        queries=queries,
        plans=keep_plans(store.plans, queries, candidates, max_rows),
        wait_stats=keep_waits(store.wait_stats, store.intervals, before, max_rows),
    )


def purge(store: Store) -> Store:
    """The store with every history table emptied; watched databases and wait filter stay."""
    return store.with_frames(
        **{
            name: df.limit(0)
            for name, df in store.tables().items()
            if name not in KEPT_ON_PURGE
        }
    )


def exclude_query(excluded: DataFrame, query_id: int) -> DataFrame:
    """Exclusion list with one more query; listing a query twice changes nothing."""
    spark = excluded.sparkSession
    more = spark.range(1).select(F.lit(query_id).cast("long").alias("query_id"))
    return excluded.union(more).dropDuplicates(["query_id"])
