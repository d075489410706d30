"""Declared schemas of the store and of its inputs."""

from __future__ import annotations

from pyspark.sql import types as T

# The measured counters and the four wait counters, by column name.
METRICS = (
    "elapsed_time",
    "rows",
    "worker_time",
    "physical_reads",
    "logical_reads",
    "logical_writes",
)
WAIT_COUNTERS = (
    "waiting_tasks_count",
    "wait_time_ms",
    "max_wait_time_ms",
    "signal_wait_time_ms",
)

INT, LONG, STRING, BINARY = T.IntegerType(), T.LongType(), T.StringType(), T.BinaryType()
TS, BOOL = T.TimestampNTZType(), T.BooleanType()


def struct(*fields: tuple[str, T.DataType] | tuple[str, T.DataType, bool]) -> T.StructType:
    """Schema from ``(name, type[, nullable])`` triples; nullable unless told otherwise."""
    return T.StructType([T.StructField(f[0], f[1], f[2] if len(f) > 2 else True) for f in fields])


def metric_fields(*stats: str) -> list[tuple[str, T.DataType]]:
    """``<stat>_<metric>`` long columns, metric by metric."""
    return [(f"{s}_{m}", LONG) for m in METRICS for s in stats]


ACTIVITY_LOG = struct(
    ("log_id", LONG), ("log_run_id", INT), ("log_timestamp", TS), ("log_message", STRING)
)
MONITORED_DATABASES = struct(("database_name", STRING))
INTERVALS = struct(("interval_id", INT), ("interval_start", TS), ("interval_end", TS))
PLAN_DBID = struct(("plan_handle", BINARY), ("dbid", INT))
PLANS = struct(
    ("plan_id", LONG),
    ("plan_fingerprint", BINARY),
    ("plan_handle", BINARY),
    ("plan_firstfound", TS),
    ("plan_database", STRING),
    ("plan_refcounts", INT),
    ("plan_usecounts", INT),
    ("plan_sizeinbytes", INT),
    ("plan_type", STRING),
    ("plan_objecttype", STRING),
    ("plan_executionplan", STRING),
    ("plan_optimization", STRING),
    ("xml_processed", INT),
)
QUERIES = struct(
    ("query_id", LONG),
    ("plan_id", LONG),
    ("query_hash", BINARY),
    ("query_plan_fingerprint", BINARY),
    ("query_statement_text", STRING),
    ("query_statement_start_offset", INT),
    ("query_statement_end_offset", INT),
    ("query_creation_time", TS),
)
EXCLUDED_QUERIES = struct(("query_id", LONG))
QUERY_RUNTIME_STATS = struct(
    ("query_id", LONG),
    ("interval_id", INT),
    ("creation_time", TS),
    ("last_execution_time", TS),
    ("execution_count", LONG),
    *metric_fields("total", "last", "min", "max", "avg"),
)
WAIT_STATS = struct(
    ("interval_id", INT), ("wait_type", STRING), *[(c, LONG) for c in WAIT_COUNTERS]
)
WAIT_TYPE_FILTER = struct(("wait_type", STRING), ("is_default", BOOL))

#: What a snapshot brings; a stored row also tells whether it holds differences or still lifetime counters.
SNAPSHOTS = {"query_runtime_stats": QUERY_RUNTIME_STATS, "wait_stats": WAIT_STATS}
STATE = "is_delta"


def stored(snapshot: T.StructType) -> T.StructType:
    """A snapshot's columns and the state of the row."""
    return T.StructType([*snapshot.fields, T.StructField(STATE, BOOL)])


STORE_TABLES: dict[str, T.StructType] = {
    "activity_log": ACTIVITY_LOG,
    "monitored_databases": MONITORED_DATABASES,
    "intervals": INTERVALS,
    "plan_dbid": PLAN_DBID,
    "plans": PLANS,
    "queries": QUERIES,
    "excluded_queries": EXCLUDED_QUERIES,
    **{name: stored(snapshot) for name, snapshot in SNAPSHOTS.items()},
    "wait_type_filter": WAIT_TYPE_FILTER,
}

#: What tells the rows of a fact apart.
KEYS = {"query_runtime_stats": ["query_id", "interval_id"], "wait_stats": ["wait_type", "interval_id"]}
#: Facts are laid out by interval, so that look-back reports prune whole folders.
PARTITIONED_BY = {"query_runtime_stats": "interval_id", "wait_stats": "interval_id"}

#: Where a store lists the facts that are gone but not yet removed from files.
EXPIRED = {"query_runtime_stats": "expired_queries", "wait_stats": "expired_waits"}


def expired(name: str) -> T.StructType:
    """Columns of that list: the key of the fact, NULL for all keys, and the last interval that is gone."""
    return T.StructType([STORE_TABLES[name][KEYS[name][0]], T.StructField("up_to", INT)])


#: Tables that describe the set-up rather than history; a purge leaves them alone.
KEPT_ON_PURGE = ("monitored_databases", "wait_type_filter")

CACHED_PLANS = struct(
    ("plan_handle", BINARY),
    ("cacheobjtype", STRING),
    ("objtype", STRING),
    ("usecounts", INT),
    ("refcounts", INT),
    ("size_in_bytes", INT),
)
PLAN_ATTRIBUTES = struct(("plan_handle", BINARY), ("attribute", STRING), ("value", STRING))
PLAN_XML = struct(("plan_handle", BINARY), ("query_plan", STRING))
SQL_TEXT = struct(("sql_handle", BINARY), ("text", STRING))
WAIT_COUNTER_INPUT = struct(("wait_type", STRING), *[(c, LONG) for c in WAIT_COUNTERS])
DATABASES = struct(("dbid", INT), ("database_name", STRING))

# Counter families of the statement statistics, in column order.
_STATS_BASE = ("worker_time", "physical_reads", "logical_writes", "logical_reads", "clr_time",
               "elapsed_time")
_STATS_LATER = ("dop", "grant_kb", "used_grant_kb", "ideal_grant_kb", "reserved_threads",
                "used_threads")


def _family(name: str) -> list[tuple[str, T.DataType]]:
    return [(f"{s}_{name}", LONG) for s in ("total", "last", "min", "max")]


QUERY_STATS = struct(
    ("sql_handle", BINARY),
    ("statement_start_offset", INT),
    ("statement_end_offset", INT),
    ("plan_generation_num", LONG),
    ("plan_handle", BINARY),
    ("creation_time", TS),
    ("last_execution_time", TS),
    ("execution_count", LONG),
    *[f for name in _STATS_BASE for f in _family(name)],
    ("query_hash", BINARY),
    ("query_plan_hash", BINARY),
    *_family("rows"),
    ("statement_sql_handle", BINARY),
    ("statement_context_id", LONG),
    *[f for name in _STATS_LATER for f in _family(name)],
)

# The version (major, minor, build) that first reports each column group.
HASHES_SINCE = (10, 0, 0)
ROWS_SINCE = (10, 50, 2500)
STATEMENT_HANDLE_SINCE = (12, 0, 0)
GRANTS_SINCE = (13, 0, 0)

VERSIONED_COLUMNS: dict[str, tuple[int, int, int]] = {
    "query_hash": HASHES_SINCE,
    "query_plan_hash": HASHES_SINCE,
    **{name: ROWS_SINCE for name, _ in _family("rows")},
    "statement_sql_handle": STATEMENT_HANDLE_SINCE,
    "statement_context_id": STATEMENT_HANDLE_SINCE,
    **{name: GRANTS_SINCE for group in _STATS_LATER for name, _ in _family(group)},
}
