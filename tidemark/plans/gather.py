"""One collection run: from server frames to the rows a store gains."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.config import StoreConfig
from tidemark.functions.times import at
from tidemark.operators import deltas, snapshots
from tidemark.operators.relational import assign_ids
from tidemark.operators.retention import retention
from tidemark.sources import ingest, log
from tidemark.sources.cleanup import cleanup
from tidemark.sources.tables import as_stored, cut_lineage, publish_run
from tidemark.store import Inputs, Store

OWN_SCHEMA = "telemetry"


@dataclass(frozen=True)
class Run:
    """Result of a run.

    ``changes`` holds what to write: rows to append, and for the facts whole
    intervals to exchange, listed in ``interval_ids``.
    ``stages`` holds the intermediate frames for inspection.  ``store`` is the
    store as it looks afterwards, expired history removed if cleanup is on;
    ``expiry`` then holds the arguments of ``cleanup``, which ``publish`` runs.
    ``skipped`` is the reason when nothing was collected.
    """

    store: Store
    changes: dict[str, DataFrame] = field(default_factory=dict)
    stages: dict[str, DataFrame] = field(default_factory=dict)
    skipped: str | None = None
    interval_ids: tuple[int, ...] = ()
    expiry: dict | None = None


def _scalar(df: DataFrame, column: str) -> int:
    return df.agg(F.coalesce(F.max(column), F.lit(0))).first()[0]


def _gate(monitored: DataFrame, budget: DataFrame | None, config: StoreConfig) -> str | None:
    """Reason not to collect, if there is one."""
    if not config.collection_active:
        return log.NOT_ACTIVE
    if monitored.isEmpty():
        return log.NOTHING_MONITORED
    if budget is not None and not budget.first()["within_budget"]:
        return log.STORE_FULL.format(config.maximum_size_mb)
    return None


def interval_events(spark: SparkSession, interval_id: int, as_of: datetime) -> DataFrame:
    """The opening of an interval and the closing of the one before it."""
    now, unset = at(as_of), F.lit(None).cast("timestamp_ntz")
    opening = F.struct(
        F.lit(interval_id).alias("interval_id"),
        now.alias("interval_start"),
        unset.alias("interval_end"),
    )
    closing = F.struct(
        F.lit(interval_id - 1).alias("interval_id"),
        unset.alias("interval_start"),
        now.alias("interval_end"),
    )
    events = [opening] if interval_id == 1 else [opening, closing]
    return spark.range(1).select(F.inline(F.array(*events)))


def apply_events(intervals: DataFrame, events: DataFrame) -> DataFrame:
    """The time dimension after the events; one row per interval."""
    return (
        intervals.unionByName(events)
        .groupBy("interval_id")
        .agg(
            F.min("interval_start").alias("interval_start"),
            F.max("interval_end").alias("interval_end"),
        )
    )


def gather(
    inputs: Inputs,
    store: Store,
    config: StoreConfig,
    as_of: datetime,
    budget: DataFrame | None = None,
    own_schema: str = OWN_SCHEMA,
    match_creation_time: bool = True,
    match_hash: bool = True,
    log_progress: bool = True,
) -> Run:
    """Collect one interval.

    ``budget`` is a ``within_budget`` frame; leave it out to skip that gate.
    ``match_creation_time`` and ``match_hash`` are those of ``match_stats`` and
    ``new_queries``.  Without ``log_progress`` the log only says why a run was
    skipped.
    Everything to be written is computed first, into the shared checkpoint
    folder: results build on the ids given to new plans and queries, and
    writing replaces an interval that the differences were taken from.
    """
    monitored = ingest.monitored_list(config, store.monitored_databases)
    run_id = _scalar(store.activity_log, "log_run_id") + 1
    log_id = _scalar(store.activity_log, "log_id")
    reason = _gate(monitored, budget, config)
    spark = store.intervals.sparkSession
    if reason is not None:
        entry = log.log_event(log.text_message(spark, reason), log_id + 1, run_id, as_of)
        logged = store.with_frames(activity_log=store.activity_log.unionByName(entry))
        run = Run(logged, {"activity_log": entry}, {}, reason)
        return _clean(run, config, as_of)

    interval_id = _scalar(store.intervals, "interval_id") + 1
    stats = inputs.query_stats

    handles = cut_lineage(
        ingest.new_plan_handles(
            inputs.cached_plans,
            inputs.plan_attributes,
            store.plan_dbid,
            monitored,
            inputs.databases,
            config.execution_threshold,
        )
    )
    found = ingest.new_plans(
        handles, inputs.cached_plans, stats, inputs.plan_xml, store.plans, inputs.databases, as_of
    ).withColumns({"plan_optimization": F.lit(None).cast("string"), "xml_processed": F.lit(0)})
    found = ingest.annotate_plans(found)
    plan_key = ["plan_fingerprint", "plan_handle", "plan_objecttype", "plan_usecounts"]
    captured = cut_lineage(
        assign_ids(found, "plan_id", plan_key, _scalar(store.plans, "plan_id")).to(schemas.PLANS)
    )
    own = ingest.self_plans(captured, own_schema)
    plans = captured.join(own, "plan_id", "left_anti")

    statements = ingest.new_queries(
        store.plans.unionByName(plans), stats, inputs.sql_text, store.queries, match_hash
    )
    query_key = [
        "query_plan_fingerprint",
        "plan_id",
        "query_statement_start_offset",
        "query_statement_end_offset",
        "query_creation_time",
    ]
    queries = cut_lineage(
        assign_ids(statements, "query_id", query_key, _scalar(store.queries, "query_id")).to(
            schemas.QUERIES
        )
    )

    tagged = stats.withColumn("interval_id", F.lit(interval_id))
    runtime = cut_lineage(
        snapshots.runtime_snapshot(
            store.queries.unionByName(queries), tagged, match_creation_time
        ).to(schemas.QUERY_RUNTIME_STATS)
    )
    waits = cut_lineage(snapshots.wait_snapshot(inputs.wait_counters, interval_id))

    # Usually the previous interval alone; more if runs have failed before they stored differences.
    first = min(
        deltas.first_pending(store.query_runtime_stats, "query_id", interval_id - 1),
        deltas.first_pending(store.wait_stats, "wait_type", interval_id - 1),
    )
    pending = F.col("interval_id").between(first, interval_id - 1)
    earlier_waits = store.wait_stats.filter(F.col("interval_id") == interval_id - 1)
    runtime_deltas = cut_lineage(
        deltas.catch_up(store.query_runtime_stats.filter(pending), runtime, deltas.runtime_delta_step)
    )
    wait_deltas = cut_lineage(
        deltas.catch_up(store.wait_stats.filter(pending), waits, deltas.wait_delta_step)
    )

    entries = store.activity_log.limit(0)
    if log_progress:
        counted = {
            ("captured ", " new plan(s)"): captured,
            ("captured ", " new queries"): queries,
            ("captured ", " runtime statistics"): runtime_deltas.filter("is_delta"),
            ("captured ", " wait statistics"): _paired_waits(earlier_waits, waits),
        }
        messages = [log.text_message(spark, log.STARTED)]
        messages += [log.count_message(df, *words) for words, df in counted.items()]
        messages.append(log.text_message(spark, log.FINISHED))
        for message in messages:
            log_id += 1
            entries = entries.unionByName(log.log_event(message, log_id, run_id, as_of))
        entries = cut_lineage(entries)

    changes = {
        "intervals": interval_events(spark, interval_id, as_of),
        "plan_dbid": handles,
        "plans": plans,
        "queries": queries,
        "query_runtime_stats": runtime_deltas.unionByName(as_stored(runtime, "query_runtime_stats")),
        "wait_stats": wait_deltas.unionByName(as_stored(waits, "wait_stats")),
        "activity_log": entries,
    }
    stages = {
        "captured_plans": captured,
        "self_plans": own,
        "runtime_snapshot": runtime,
        "wait_snapshot": waits,
        "runtime_deltas": runtime_deltas,
        "wait_deltas": wait_deltas,
    }
    after = store.with_frames(
        intervals=apply_events(store.intervals, changes["intervals"]),
        plan_dbid=store.plan_dbid.unionByName(handles),
        plans=store.plans.unionByName(plans),
        queries=store.queries.unionByName(queries),
        query_runtime_stats=store.query_runtime_stats.filter(~pending).unionByName(
            changes["query_runtime_stats"]
        ),
        wait_stats=store.wait_stats.filter(~pending).unionByName(changes["wait_stats"]),
        activity_log=store.activity_log.unionByName(entries),
    )
    run = Run(after, changes, stages, interval_ids=tuple(range(first, interval_id + 1)))
    return _clean(run, config, as_of)


def _paired_waits(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """Waits of the earlier snapshot that the later one has too."""
    return earlier.join(later.select("wait_type"), "wait_type", "left_semi")


def _clean(run: Run, config: StoreConfig, as_of: datetime) -> Run:
    """Expire history when cleanup is on; this also happens after a skipped collection.

    Only ``store`` shows it.  ``publish`` carries it out on the files and then
    logs it.
    """
    if not config.data_cleanup_active:
        return run
    days, throttle = config.data_cleanup_threshold, config.data_cleanup_throttle
    expiry = {"as_of": as_of, "days": days, "max_rows": throttle}
    return replace(run, store=retention(run.store, as_of, days, throttle), expiry=expiry)


def publish(run: Run, root: str, log_progress: bool = True) -> None:
    """Write what a run collected, and expire history on the files if it asks for it."""
    publish_run(run.changes, root, run.interval_ids)
    if run.expiry is not None:
        cleanup(run.store.intervals.sparkSession, root, **run.expiry, log_progress=log_progress)
