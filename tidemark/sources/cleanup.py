"""Retention on a stored store, touching no file of a fact."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.functions.times import at
from tidemark.operators import retention as r
from tidemark.sources import log
from tidemark.sources.tables import append_rows, cut_lineage, expire, fact_files, read_store, read_table, swap_table
from tidemark.store import Store


def _expire_waits(spark: SparkSession, store: Store, root: str, before: datetime, max_rows: int | None) -> None:
    if max_rows is None:
        last = r.newest_expired_interval(store.intervals, before)
        limits = spark.range(1).select(F.lit(None).cast("string").alias("wait_type"), last.alias("up_to"))
        limits = limits.filter("up_to IS NOT NULL")
    else:
        gone = r.expired_waits(store.wait_stats, store.intervals, before, max_rows)
        limits = gone.groupBy("wait_type").agg(F.max("interval_id").alias("up_to"))
    limits = cut_lineage(limits)
    if not limits.isEmpty():
        expire(limits, root, "wait_stats")


def cleanup(
    spark: SparkSession,
    root: str,
    as_of: datetime,
    days: int,
    max_rows: int | None = None,
    log_progress: bool = False,
) -> Store:
    """Apply ``retention`` to the store under ``root`` and read it again.

    With ``log_progress`` the log says so once everything is removed.

    Facts are not rewritten: what expires is listed, as queries and wait types
    with the last interval that is gone, and readers leave it out.  The rows
    that one step removes of a key are its earliest, with ``max_rows`` too, so
    one number a key tells them.  ``compact`` removes them from the files, now
    and then.  The small tables are written anew and exchanged.  Nothing may
    read or write the store meanwhile.
    """
    facts = fact_files(spark, root)
    store = read_store(spark, root, facts)
    before = r.cutoff(as_of, days)
    runtime = store.query_runtime_stats
    if max_rows is None:
        # Whole queries go, so the newest of each query tells all; the facts are read once.
        newest = [F.max(c).alias(c) for c in ("last_execution_time", "interval_id")]
        runtime = cut_lineage(runtime.groupBy("query_id").agg(*newest))
    candidates = cut_lineage(r.retention_candidates(runtime, store.queries, before))
    gone = r.expired_runtime(runtime, candidates, max_rows)
    limits = cut_lineage(gone.groupBy("query_id").agg(F.max("interval_id").alias("up_to")))
    if not limits.isEmpty():
        expire(limits, root, "query_runtime_stats")
    if max_rows is not None:
        left = read_store(spark, root, facts).query_runtime_stats
        candidates = cut_lineage(r.without_runtime(candidates, left, max_rows))
    if not candidates.isEmpty():
        queries = cut_lineage(r.keep_queries(store.queries, candidates, max_rows))
        plans = r.keep_plans(store.plans, queries, candidates, max_rows)
        swap_table(plans, root, "plans")
        swap_table(queries, root, "queries")
    _expire_waits(spark, store, root, before, max_rows)
    if not store.activity_log.filter(F.col("log_timestamp") < at(before)).isEmpty():
        swap_table(r.keep_log(store.activity_log, before, max_rows), root, "activity_log")
    if log_progress:
        last = read_table(spark, root, "activity_log").agg(F.max("log_run_id"), F.max("log_id")).first()
        entry = log.log_event(log.text_message(spark, log.CLEANED), (last[1] or 0) + 1, last[0] or 1, as_of)
        append_rows(entry, root, "activity_log")
    return read_store(spark, root, facts)
