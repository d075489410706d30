"""SQL counterparts of the registered queries, for DuckDB over the same tables.

Written from the meaning of each query rather than from its Spark plan: counters
as each run sees them are hourly sums, added up along the hours.
"""

from __future__ import annotations

from tidemark.schemas import QUERY_STATS, VERSIONED_COLUMNS

METRICS = ("elapsed_time", "rows", "worker_time", "physical_reads", "logical_reads", "logical_writes")
TOTALS = [f"total_{m}" for m in METRICS]
COUNTERS = ["execution_count", *TOTALS]
WAIT_COLUMNS = ("waiting_tasks_count", "wait_time_ms", "max_wait_time_ms", "signal_wait_time_ms")
EPOCH = "TIMESTAMP '2024-01-01 00:00:00'"
AS_OF = "TIMESTAMP '2024-01-30 23:00:00'"


def ctes(*parts: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in parts) + "\n"


def hexid(x: str) -> str:
    return f"printf('%016X', {x})"


def offsets(x: str) -> tuple[str, str]:
    start = f"CAST(2 * ({x} % 10) AS INTEGER)"
    return start, f"CAST(CASE WHEN {x} % 3 = 0 THEN -1 ELSE {start} + 100 END AS INTEGER)"


MEASURED = (
    "measured",
    """
    SELECT user_id, event_type, event_id, ts,
           elapsed_time, "rows", elapsed_time // 2 AS worker_time,
           event_id % 7 AS physical_reads, event_id % 101 AS logical_reads,
           event_id % 13 AS logical_writes
    FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS elapsed_time,
                 CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS "rows" FROM events)
""",
)
INTERVALS = (
    "iv",
    f"""
    SELECT CAST(h + 1 AS INTEGER) AS interval_id,
           {EPOCH} + to_hours(h) AS interval_start,
           CASE WHEN h < last_h THEN {EPOCH} + to_hours(h + 1) END AS interval_end
    FROM (SELECT unnest(range(0, last_h + 1)) AS h, last_h
          FROM (SELECT date_diff('hour', {EPOCH}, max(ts)) AS last_h FROM events))
""",
)
HOURS = (
    "hours",
    "SELECT user_id, event_type, user_id % 20 AS slot, "
    f"CAST(date_diff('hour', {EPOCH}, date_trunc('hour', ts)) + 2 AS INTEGER) AS interval_id, "
    "max(ts) AS last_at, count(*) AS n, sum(event_id % 11) AS signal, "
    + ", ".join(
        f'sum("{m}") AS sum_{m}, arg_max("{m}", ts) AS last_{m}, min("{m}") AS min_{m}, max("{m}") AS max_{m}'
        for m in METRICS
    )
    + " FROM measured GROUP BY ALL",
)
HANDLES = (
    "handles",
    "SELECT * FROM (SELECT k.user_id, k.event_type, iv.interval_id, iv.interval_start, "
    "max(last_at) OVER past AS last_execution_time, sum(n) OVER past AS execution_count, "
    + ", ".join(
        f"sum(sum_{m}) OVER past AS total_{m}, last_value(last_{m} IGNORE NULLS) OVER past AS last_{m}, "
        f"min(min_{m}) OVER past AS min_{m}, max(max_{m}) OVER past AS max_{m}"
        for m in METRICS
    )
    + " FROM (SELECT user_id, event_type, min(interval_id) AS first_id FROM hours GROUP BY ALL) k "
    "JOIN iv ON iv.interval_id >= k.first_id LEFT JOIN hours h "
    "ON h.user_id = k.user_id AND h.event_type = k.event_type AND h.interval_id = iv.interval_id "
    "WINDOW past AS (PARTITION BY k.user_id, k.event_type ORDER BY iv.interval_id "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) "
    "WHERE last_execution_time >= interval_start - INTERVAL 72 HOUR",
)
BORN = ("born", "SELECT user_id, min(ts) AS creation_time FROM events GROUP BY user_id")
SNAP = (
    "snap",
    "SELECT user_id AS query_id, interval_id, any_value(creation_time) AS creation_time, "
    "max(last_execution_time) AS last_execution_time, "
    "CAST(sum(execution_count) AS BIGINT) AS execution_count, "
    + ", ".join(
        f"CAST(sum(total_{m}) AS BIGINT) AS total_{m}, CAST(sum(last_{m}) AS BIGINT) AS last_{m}, "
        f"min(min_{m}) AS min_{m}, max(max_{m}) AS max_{m}, CAST(0 AS BIGINT) AS avg_{m}"
        for m in METRICS
    )
    + " FROM handles JOIN born USING (user_id) GROUP BY user_id, interval_id",
)


def with_next(table: str, key: str, counters: list[str]) -> str:
    """Rows with the counters of the key's next row, and whether that is of the following interval."""
    leads = ", ".join(f"lead({c}) OVER along AS next_{c}" for c in counters)
    return (
        f"SELECT *, coalesce((lead(interval_id) OVER along) = interval_id + 1, false) AS is_delta, {leads} "
        f"FROM {table} WINDOW along AS (PARTITION BY {key} ORDER BY interval_id)"
    )


def delta_body(zeroed: bool = False) -> str:
    def step(c: str) -> str:
        d = f"next_{c} - {c}"
        return f"greatest({d}, 0)" if zeroed else d

    def metric(m: str) -> str:
        mean = f"coalesce(({step('total_' + m)}) // nullif({step('execution_count')}, 0), 0)"
        return (
            f"CASE WHEN is_delta THEN {step('total_' + m)} ELSE total_{m} END AS total_{m}, "
            f"last_{m}, min_{m}, max_{m}, CASE WHEN is_delta THEN {mean} ELSE avg_{m} END AS avg_{m}"
        )

    return (
        "SELECT query_id, interval_id, creation_time, last_execution_time, "
        f"CASE WHEN is_delta THEN {step('execution_count')} ELSE execution_count END AS execution_count, "
        + ", ".join(metric(m) for m in METRICS)
        + ", is_delta FROM ("
        + with_next("snap", "query_id", ["execution_count", *[f"total_{m}" for m in METRICS]])
        + ")"
    )


DELTA = ("qrs", delta_body())
RUNTIME = (MEASURED, INTERVALS, HOURS, HANDLES, BORN, SNAP)
HISTORY = (*RUNTIME, DELTA)

WAIT_SNAP = (
    "wsnap",
    """
    SELECT * FROM (
        SELECT iv.interval_id, k.wait_type,
               CAST(sum(n) OVER past AS BIGINT) AS waiting_tasks_count,
               CAST(sum(elapsed) OVER past AS BIGINT) AS wait_time_ms,
               max(longest) OVER past AS max_wait_time_ms,
               CAST(sum(signal) OVER past AS BIGINT) AS signal_wait_time_ms
        FROM (SELECT wait_type, min(interval_id) AS first_id FROM by_type GROUP BY wait_type) k
        JOIN iv ON iv.interval_id >= k.first_id
        LEFT JOIN by_type b ON b.wait_type = k.wait_type AND b.interval_id = iv.interval_id
        WINDOW past AS (PARTITION BY k.wait_type ORDER BY iv.interval_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    ) WHERE waiting_tasks_count > 0 AND wait_time_ms > 0
""",
)
BY_TYPE = (
    "by_type",
    "SELECT event_type || '_' || CAST(slot AS VARCHAR) AS wait_type, interval_id, sum(n) AS n, "
    "sum(sum_elapsed_time) AS elapsed, max(max_elapsed_time) AS longest, sum(signal) AS signal "
    "FROM hours GROUP BY 1, 2",
)
WAIT_DELTA = (
    "ws",
    "SELECT * FROM (SELECT interval_id, wait_type, "
    + ", ".join(f"CASE WHEN is_delta THEN next_{c} - {c} ELSE {c} END AS {c}" for c in WAIT_COLUMNS)
    + f", is_delta FROM ({with_next('wsnap', 'wait_type', list(WAIT_COLUMNS))})) "
    "WHERE NOT (is_delta AND waiting_tasks_count = 0)",
)
WAITS = (MEASURED, INTERVALS, HOURS, BY_TYPE, WAIT_SNAP, WAIT_DELTA)
FILTERED = (
    "filtered",
    "SELECT DISTINCT 'error_' || CAST(user_id % 20 AS VARCHAR) AS wait_type FROM events "
    "WHERE event_type = 'error' AND user_id % 20 < 5",
)

OBJECT_TYPE = "CASE {0} % 3 WHEN 0 THEN 'Adhoc' WHEN 1 THEN 'Prepared' ELSE 'Proc' END"
PLANS = (
    "plans",
    f"SELECT c_custkey AS plan_id, c_mktsegment AS plan_database, "
    f"{OBJECT_TYPE.format('c_custkey')} AS plan_objecttype, "
    f"{hexid('c_nationkey')} || {hexid('c_custkey % 4')} AS plan_fingerprint FROM customer",
)
QUERIES = (
    "queries",
    f"SELECT c_custkey AS query_id, c_custkey AS plan_id, {hexid('c_nationkey')} AS query_hash FROM customer",
)
EXCLUDED = ("excluded", "SELECT c_custkey AS query_id FROM customer WHERE c_custkey % 10 = 3")
LOG = (
    "log",
    f"""
    SELECT conv_id * 1000 + turn AS log_id, conv_id AS log_run_id,
           {EPOCH} + to_hours(conv_id * 71 % 720) AS log_timestamp, text AS log_message
    FROM conversations
""",
)


def recent(hours: int) -> tuple[str, str]:
    return (
        "recent",
        f"SELECT * FROM iv WHERE interval_end >= {AS_OF} - INTERVAL {hours} HOUR "
        "AND interval_id < (SELECT max(interval_id) FROM iv)",
    )


def label(ts: str) -> str:
    return f"strftime({ts}, '%H:%M:%S')"


def top_runtime(measure: str, name: str) -> str:
    return ctes(*HISTORY, QUERIES, EXCLUDED, recent(24)) + f"""
    SELECT {measure} AS {name}, query_id
    FROM qrs SEMI JOIN queries USING (query_id) ANTI JOIN excluded USING (query_id)
    SEMI JOIN recent USING (interval_id)
    WHERE execution_count > 0 GROUP BY query_id ORDER BY {name} DESC, query_id LIMIT 10"""


def by_database(hours: int, measures: list[str], time: str) -> str:
    sums = ", ".join(f"CAST(sum({m}) AS BIGINT) AS {m}" for m in measures)
    return f"""
    SELECT {time} AS time_date, plan_database AS database_name, {sums}
    FROM qrs ANTI JOIN excluded USING (query_id)
    JOIN (SELECT query_id, plan_database FROM queries JOIN plans USING (plan_id)) USING (query_id)
    JOIN recent USING (interval_id)
    WHERE execution_count > 0 GROUP BY ALL"""


def database_report(hours: int, measures: list[str], time: str = label("interval_end")) -> str:
    return ctes(*HISTORY, QUERIES, PLANS, EXCLUDED, recent(hours)) + by_database(hours, measures, time)


RECENT_WAITS = (
    "recent_waits",
    "SELECT * FROM ws JOIN recent USING (interval_id) "
    "WHERE wait_type NOT IN (SELECT wait_type FROM filtered)",
)
WAIT_REPORT = (*WAITS, FILTERED, recent(24), RECENT_WAITS)
TOP_WAITS = (
    "top_waits",
    "SELECT wait_type, CAST(sum(wait_time_ms) AS BIGINT) AS total_wait_time FROM recent_waits "
    "GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
PER_INTERVAL = (
    "per_interval",
    f"SELECT {label('interval_end')} AS time_date, CAST(sum(wait_time_ms) AS BIGINT) AS total_wait_time, "
    "CAST(sum(waiting_tasks_count) AS BIGINT) AS waiting_tasks FROM recent_waits GROUP BY 1 ORDER BY 1 LIMIT 10",
)


def top3(order: str) -> str:
    return ctes(*WAIT_REPORT) + f"""
    SELECT {label('interval_end')} AS time_date, wait_type, wait_time_ms, row_number() OVER place AS r
    FROM recent_waits WINDOW place AS (PARTITION BY interval_id ORDER BY {order}) QUALIFY r <= 3"""


DISTINCT = f"""
    SELECT {label('last_execution_time')} AS time_date, len(list_distinct(list(query_id))) AS distinct_queries
    FROM qrs ANTI JOIN excluded USING (query_id)
    WHERE last_execution_time >= {AS_OF} - INTERVAL {{hours}} HOUR GROUP BY last_execution_time"""
SHAPES = (
    ("shape", "SELECT query_hash, min(query_id) AS first_id FROM queries GROUP BY ALL"),
    (
        "tally",
        """
        SELECT query_hash, plan_database AS query_database, count(*) AS members
        FROM (queries ANTI JOIN excluded USING (query_id)) JOIN plans USING (plan_id) GROUP BY ALL
    """,
    ),
)
MULTIPLE = """
    SELECT query_database, first_id AS query_id, plan_id
    FROM (SELECT * FROM tally WHERE members > 1) JOIN shape USING (query_hash)
    JOIN (SELECT query_hash, plan_id, plan_database FROM queries JOIN plans USING (plan_id)) USING (query_hash)"""


# -- collection inputs -------------------------------------------------------

CACHE = (
    "cache",
    f"""
    SELECT p_partkey, {hexid('p_partkey')} AS plan_handle,
           CASE WHEN p_partkey % 4 = 0 THEN 'Parse Tree' ELSE 'Compiled Plan' END AS cacheobjtype,
           {OBJECT_TYPE.format('p_partkey')} AS objtype, p_size AS usecounts,
           p_size % 4 + 1 AS refcounts, p_size * 1024 AS size_in_bytes
    FROM part
""",
)
COMPILED = ("compiled", "SELECT * FROM cache WHERE cacheobjtype = 'Compiled Plan' AND usecounts >= 2")
PIVOTED = (
    "pivoted",
    """
    SELECT plan_handle, CASE WHEN p_partkey % 11 <> 0 THEN p_size % 5 END AS dbid,
           CASE WHEN p_partkey % 11 <> 0 THEN p_brand END AS sql_handle
    FROM compiled JOIN part USING (p_partkey)
""",
)
NEW_HANDLES = (
    "new_handles",
    f"""
    SELECT plan_handle, dbid FROM pivoted
    WHERE dbid IN (SELECT r_regionkey FROM region WHERE r_regionkey IN (1, 3))
      AND plan_handle NOT IN (SELECT {hexid('p_partkey')} FROM part WHERE p_partkey % 5 = 0)
""",
)
HANDLE_PARTS = (CACHE, COMPILED, PIVOTED, NEW_HANDLES)
XML = (
    "xml",
    f"""
    SELECT p_partkey, plan_handle, CASE WHEN p_partkey % 29 = 0 THEN NULL
        WHEN p_partkey % 23 = 0 THEN left(doc, length(doc) - 20) ELSE doc END AS query_plan
    FROM (SELECT p_partkey, {hexid('p_partkey')} AS plan_handle,
        '<ShowPlanXML xmlns="urn:example:showplan"><BatchSequence><Batch><Statements><StmtSimple'
        || CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 2 = 0 THEN ' StatementOptmLevel="TRIVIAL"'
                ELSE ' StatementOptmLevel="FULL"' END
        || '><ColumnReference Schema="[' || CASE WHEN p_partkey % 17 = 0 THEN 'telemetry' ELSE 'dbo' END
        || ']" Column="' || p_partkey || '"/></StmtSimple></Statements></Batch></BatchSequence></ShowPlanXML>'
        AS doc FROM part)
""",
)
STATEMENTS = (
    "statements",
    f"""
    SELECT l_partkey, l_linenumber, {hexid('l_partkey')} AS plan_handle, {hexid('l_partkey')} AS sql_handle,
           {hexid('l_partkey * 8 + l_linenumber')} AS query_hash, {hexid('l_partkey % 97')} AS query_plan_hash,
           CAST((l_linenumber - 1) * 20 AS INTEGER) AS start_offset,
           CAST(CASE WHEN l_linenumber = 7 THEN -1 ELSE (l_linenumber - 1) * 20 + 40 END AS INTEGER) AS end_offset,
           min(l_shipdate) AS creation_time
    FROM lineitem GROUP BY l_partkey, l_linenumber
""",
)
CAPTURED_QUERIES = f"""
    SELECT p.l_partkey * 8 + p.l_linenumber AS plan_id, s.query_hash,
           p.query_hash || p.query_plan_hash || s.query_hash AS query_plan_fingerprint,
           substring(text, s.start_offset // 2 + 1,
               (CASE WHEN s.end_offset = -1 THEN 2 * length(text) ELSE s.end_offset END - s.start_offset) // 2 + 1)
               AS query_statement_text,
           s.start_offset AS query_statement_start_offset, s.end_offset AS query_statement_end_offset,
           s.creation_time AS query_creation_time
    FROM statements p JOIN statements s ON p.plan_handle = s.plan_handle {{match}}
    JOIN documents d ON {hexid('d.doc_id')} = s.sql_handle
    WHERE p.query_hash || p.query_plan_hash || s.query_hash NOT IN
        (SELECT query_hash || query_plan_hash || query_hash FROM statements WHERE l_partkey % 13 = 0)"""

SERVER_VERSIONS = ("9.0.4035.0", "10.0.1600.0", "10.50.2500.0", "12.0.2000.8", "13.0.1601.5")
VERSIONS = (
    "versions",
    f"SELECT p_partkey, CAST(p_size AS BIGINT) AS n, [{', '.join(repr(v) for v in SERVER_VERSIONS)}]"
    "[p_partkey % 5 + 1] AS version FROM part",
)
PARTS = (
    "parts",
    """
    SELECT *, CAST(split_part(version, '.', 1) AS BIGINT) AS major,
           CAST(split_part(version, '.', 2) AS BIGINT) AS minor,
           CAST(split_part(version, '.', 3) AS BIGINT) AS build FROM versions
""",
)
KINDS = {"BinaryType": "VARCHAR", "LongType": "BIGINT", "IntegerType": "INTEGER", "TimestampNTZType": "TIMESTAMP"}


def aligned() -> str:
    """Every column of the common schema: 0 or NULL where the part's server is older than the column."""
    out = []
    for i, field in enumerate(QUERY_STATS.fields):
        kind = KINDS[type(field.dataType).__name__]
        value = {
            "VARCHAR": hexid(f"p_partkey % {70 + i}"),
            "BIGINT": f"n * {i + 1}",
            "INTEGER": f"CAST(p_partkey % {7 + i} AS INTEGER)",
            "TIMESTAMP": f"{EPOCH} + to_hours(p_partkey % {70 + i})",
        }[kind]
        if field.name in VERSIONED_COLUMNS:
            major, minor, build = VERSIONED_COLUMNS[field.name]
            bound = (major * 1000 + minor) * 100000 + build
            missing = "0" if kind == "BIGINT" and field.name != "statement_context_id" else "NULL"
            value = f"CASE WHEN (major * 1000 + minor) * 100000 + build >= {bound} THEN {value} ELSE {missing} END"
        out.append(f"CAST({value} AS {kind}) AS {field.name}")
    return ", ".join(out)


HAS_ROWS = "(major * 1000 + minor) * 100000 + build >= 1005002500"

# -- retention ---------------------------------------------------------------

CUTOFF = f"({AS_OF} - INTERVAL 1 DAY)"
AGING = (
    *HISTORY,
    ("queries", "SELECT c_custkey AS query_id, c_custkey - c_custkey % 2 AS plan_id FROM customer"),
    ("plans", "SELECT c_custkey AS plan_id, c_mktsegment AS plan_database FROM customer WHERE c_custkey % 2 = 0"),
    (
        "candidates",
        f"""
        SELECT q.query_id, q.plan_id FROM queries q JOIN
            (SELECT query_id, max(last_execution_time) AS last_seen FROM qrs GROUP BY 1) d USING (query_id)
        WHERE last_seen < {CUTOFF}
    """,
    ),
    ("kept_queries", "SELECT * FROM queries WHERE query_id NOT IN (SELECT query_id FROM candidates)"),
)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
PURGED = (
    "activity_log intervals plan_dbid plans queries excluded_queries query_runtime_stats wait_stats".split()
)

ORACLE: dict[str, str] = {
    "plan_filter": ctes(CACHE, COMPILED) + "SELECT * EXCLUDE (p_partkey) FROM compiled",
    "plan_attr_pivot": ctes(CACHE, COMPILED, PIVOTED) + "SELECT * FROM pivoted",
    "monitored_plans": ctes(CACHE, COMPILED, PIVOTED)
    + "SELECT * FROM pivoted WHERE dbid IN (SELECT r_regionkey FROM region WHERE r_regionkey IN (1, 3))",
    "new_plan_handles": ctes(*HANDLE_PARTS) + "SELECT * FROM new_handles",
    "new_plans": ctes(*HANDLE_PARTS, XML, STATEMENTS) + f"""
    SELECT query_hash || query_plan_hash AS plan_fingerprint, h.plan_handle,
           {AS_OF} AS plan_firstfound, r_name AS plan_database, refcounts AS plan_refcounts,
           usecounts AS plan_usecounts, size_in_bytes AS plan_sizeinbytes, cacheobjtype AS plan_type,
           objtype AS plan_objecttype, query_plan AS plan_executionplan
    FROM new_handles h JOIN cache c ON h.plan_handle = c.plan_handle
    JOIN statements s ON s.plan_handle = h.plan_handle
    JOIN xml x ON x.plan_handle = h.plan_handle JOIN region ON r_regionkey = dbid
    WHERE cacheobjtype = 'Compiled Plan' AND query_plan IS NOT NULL
      AND query_hash || query_plan_hash NOT IN
          (SELECT query_hash || query_plan_hash FROM statements WHERE l_partkey % 7 = 0)""",
    "new_queries": ctes(STATEMENTS) + CAPTURED_QUERIES.format(match=""),
    "new_queries_matched": ctes(STATEMENTS)
    + CAPTURED_QUERIES.format(
        match="AND p.query_hash = s.query_hash AND p.query_plan_hash = s.query_plan_hash"
    ),
    "fingerprint": ctes(PLANS) + "SELECT plan_id, plan_fingerprint FROM plans",
    "statement_slice": f"""
    SELECT doc_id, CAST(2 * length(text) AS BIGINT) AS text_bytes,
        substring(text, s // 2 + 1, (CASE WHEN e = -1 THEN 2 * length(text) ELSE e END - s) // 2 + 1) AS statement_text
    FROM (SELECT doc_id, text, {offsets('doc_id')[0]} AS s, {offsets('doc_id')[1]} AS e FROM documents)""",
    "align_schema": ctes(VERSIONS, PARTS) + f"SELECT {aligned()} FROM parts",
    "align_union": ctes(VERSIONS, PARTS) + f"SELECT {aligned()} FROM parts",
    "version_parts": ctes(VERSIONS, PARTS)
    + f"SELECT p_partkey, major, minor, build, major >= 10 AS has_hashes, {HAS_ROWS} AS has_rows, "
    "major >= 13 AS has_grants, major >= 12 AS has_statement_handle FROM parts",
    "plan_optimization": ctes(XML) + """
    SELECT p_partkey AS plan_id, CASE WHEN query_plan NOT LIKE '%</ShowPlanXML>' THEN NULL
        WHEN level = 'T' THEN 'Trivial' WHEN level = 'F' THEN 'Full' END AS plan_optimization,
        CAST(1 AS INTEGER) AS xml_processed
    FROM (SELECT *, regexp_extract(query_plan, 'StatementOptmLevel="([A-Z])', 1) AS level FROM xml)
    WHERE query_plan IS NOT NULL""",
    "drop_self": ctes(
        XML,
        (
            "own",
            "SELECT p_partkey FROM xml WHERE query_plan LIKE '%</ShowPlanXML>' "
            "AND regexp_matches(query_plan, 'ColumnReference Schema=\"\\[telemetry\\]\"')",
        ),
    )
    + """
    SELECT 'query' AS kind, l_orderkey * 8 + l_linenumber AS id, l_partkey AS plan_id FROM lineitem
    WHERE l_partkey NOT IN (SELECT p_partkey FROM own)
    UNION ALL
    SELECT 'plan', p_partkey, p_partkey FROM xml
    WHERE query_plan IS NOT NULL AND p_partkey NOT IN (SELECT p_partkey FROM own)""",
    "table_rows": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, CAST({i + 1} AS BIGINT) AS table_id, 'U' AS table_type, "
        f"count(*) AS row_count FROM {t}"
        for i, t in enumerate(TABLES)
    ),
    "purge": ctes(FILTERED)
    + " UNION ALL ".join(
        [f"SELECT '{t}' AS table_name, CAST(0 AS BIGINT) AS row_count" for t in PURGED]
        + [
            "SELECT 'wait_type_filter', count(*) FROM filtered",
            "SELECT 'monitored_databases', count(*) FROM region WHERE r_regionkey IN (1, 3)",
        ]
    ),
    "assign_ids": ctes(LOG) + """
    SELECT conv_id, turn, (SELECT max(log_id) FROM log) + row_number() OVER (
        ORDER BY substring(md5(conv_id || chr(31) || turn), 1, 3), conv_id, turn) AS log_id
    FROM conversations""",
    "next_run_id": ctes(LOG) + "SELECT CAST(coalesce(max(log_run_id), 0) + 1 AS INTEGER) AS log_run_id FROM log",
    "log_messages": ctes(*HANDLE_PARTS, LOG, QUERIES) + f"""
    SELECT (SELECT max(log_id) FROM log) + i AS log_id,
        (SELECT CAST(max(log_run_id) + 1 AS INTEGER) FROM log) AS log_run_id, {AS_OF} AS log_timestamp, log_message
    FROM (SELECT 1 AS i, 'captured ' || count(*) || ' new plan(s)' AS log_message FROM new_handles
          UNION ALL SELECT 2, 'captured ' || count(*) || ' new queries' FROM queries)""",
    "exclude_query": ctes(EXCLUDED) + "SELECT query_id FROM excluded UNION SELECT 4",
    "wait_snapshot": ctes(MEASURED, INTERVALS, HOURS, BY_TYPE, WAIT_SNAP) + "SELECT * FROM wsnap",
    "runtime_snapshot": ctes(*RUNTIME) + "SELECT * FROM snap",
    "intervals": ctes(INTERVALS) + "SELECT * FROM iv",
    "closed_intervals": ctes(INTERVALS, recent(24)) + "SELECT * FROM recent",
    "not_excluded": ctes(QUERIES, EXCLUDED)
    + "SELECT query_id, plan_id FROM queries ANTI JOIN excluded USING (query_id)",
    "runtime_delta": ctes(*HISTORY) + "SELECT * FROM qrs",
    "runtime_delta_strict": ctes(*HISTORY) + "SELECT * FROM qrs WHERE is_delta",
    "runtime_delta_zeroed": ctes(*RUNTIME, ("qrs", delta_body(zeroed=True)))
    + "SELECT * FROM qrs",
    "runtime_delta_blocks": ctes(*HISTORY) + "SELECT * FROM qrs",
    "runtime_delta_latest": ctes(*HISTORY)
    + "SELECT * FROM qrs WHERE interval_id = (SELECT max(interval_id) - 1 FROM iv)",
    "wait_delta": ctes(*WAITS) + "SELECT * FROM ws",
    "catch_up": ctes(*HISTORY) + "SELECT * FROM qrs",
    "stream_runtime_landed": ctes(*HISTORY) + "SELECT * FROM qrs",
    "stream_waits_landed": ctes(*WAITS) + "SELECT * FROM ws",
    "top_avg_duration": top_runtime("CAST(sum(avg_elapsed_time) AS BIGINT) // count(avg_elapsed_time)", "avg_elapsed_time"),
    "top_executions": top_runtime("CAST(sum(execution_count) AS BIGINT)", "count_exec"),
    "distinct_queries": ctes(*HISTORY, EXCLUDED) + DISTINCT.format(hours=24),
    "distinct_queries_chart": ctes(*HISTORY, EXCLUDED, ("d", DISTINCT.format(hours=192)))
    + "SELECT time_date, CAST(sum(distinct_queries) AS BIGINT) AS distinct_queries FROM d GROUP BY 1",
    "plan_variety": ctes(PLANS) + "SELECT plan_objecttype, count(plan_id) AS plan_count FROM plans GROUP BY 1",
    "worker_time": database_report(192, ["avg_worker_time"]),
    "worker_time_by_timestamp": database_report(192, ["avg_worker_time"], "interval_end"),
    "worker_time_matrix": ctes(
        *HISTORY, QUERIES, PLANS, EXCLUDED, recent(192),
        ("d", by_database(192, ["avg_worker_time"], label("interval_end"))),
    )
    + "SELECT time_date, "
    + ", ".join(
        f"CAST(sum(avg_worker_time) FILTER (database_name = '{s}') AS BIGINT) AS \"{s}\""
        for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    )
    + " FROM d GROUP BY 1",
    "io": database_report(24, ["avg_logical_reads", "avg_logical_writes"]),
    "elapsed_time": database_report(192, ["avg_elapsed_time"]),
    "item_count": ctes(
        *HISTORY, BY_TYPE, WAIT_SNAP, WAIT_DELTA, QUERIES, PLANS,
        ("per_query", "SELECT query_id, count(*) AS n FROM qrs GROUP BY 1"),
    )
    + """
    SELECT plan_database AS "database", count(*) AS queries, count(DISTINCT plan_id) AS plans,
        (SELECT count(*) FROM iv) AS intervals, CAST(sum(n) AS BIGINT) AS runtime_stats,
        (SELECT count(*) FROM ws) AS wait_stats
    FROM per_query JOIN queries USING (query_id) JOIN plans USING (plan_id) GROUP BY 1""",
    "last_log": ctes(LOG) + "SELECT * FROM log WHERE log_run_id = (SELECT max(log_run_id) FROM log)",
    "multiple_plans": ctes(QUERIES, PLANS, EXCLUDED, *SHAPES) + MULTIPLE,
    "multiple_plans_same_db": ctes(QUERIES, PLANS, EXCLUDED, *SHAPES)
    + MULTIPLE + " WHERE plan_database = query_database",
    "multiple_plans_chart": ctes(QUERIES, PLANS, EXCLUDED, *SHAPES, ("d", MULTIPLE))
    + "SELECT query_id, query_database, count(plan_id) AS plan_count FROM d GROUP BY 1, 2",
    "excluded_count": ctes(EXCLUDED) + "SELECT count(*) AS excluded_query_count FROM excluded",
    "wait_filter_count": ctes(FILTERED) + "SELECT count(*) AS wait_type_filter_count FROM filtered",
    "captions": ctes(EXCLUDED, FILTERED)
    + "SELECT 'Excluded queries: ' || count(*) AS caption FROM excluded "
    "UNION ALL SELECT 'Filtered wait types: ' || count(*) FROM filtered",
    "top_waits": ctes(*WAIT_REPORT, TOP_WAITS) + "SELECT * FROM top_waits",
    "top3_waits": top3("wait_type"),
    "top3_waits_by_time": top3("wait_time_ms DESC, wait_type"),
    "wait_time_per_interval": ctes(*WAIT_REPORT, PER_INTERVAL) + "SELECT * FROM per_interval",
    "wait_percent": ctes(*WAIT_REPORT, TOP_WAITS)
    + "SELECT *, CAST(total_wait_time AS DOUBLE) / CAST(sum(total_wait_time) OVER () AS DOUBLE) AS share FROM top_waits",
    "wait_moving_avg": ctes(*WAIT_REPORT, PER_INTERVAL)
    + "SELECT *, avg(CAST(total_wait_time AS DOUBLE)) OVER (ORDER BY time_date ROWS 1 PRECEDING) AS moving_avg "
    "FROM per_interval",
    "task_moving_avg": ctes(*WAIT_REPORT, PER_INTERVAL)
    + "SELECT *, CASE WHEN row_number() OVER (ORDER BY time_date) > 1 THEN "
    "avg(CAST(waiting_tasks AS DOUBLE)) OVER (ORDER BY time_date ROWS 1 PRECEDING) END AS moving_avg "
    "FROM per_interval",
    "retention_candidates": ctes(*AGING) + "SELECT * FROM candidates",
    "retention_stats": ctes(*AGING)
    + "SELECT * FROM qrs "
    "WHERE query_id NOT IN (SELECT query_id FROM candidates)",
    "retention_queries": ctes(*AGING) + "SELECT query_id, plan_id FROM kept_queries",
    "retention_plans": ctes(*AGING) + """
    SELECT plan_id, plan_database FROM plans p WHERE NOT (plan_id IN (SELECT plan_id FROM candidates)
        AND NOT EXISTS (SELECT 1 FROM kept_queries k WHERE k.plan_id = p.plan_id))""",
    "retention_waits": ctes(*WAITS) + f"""
    SELECT * EXCLUDE (is_delta) FROM ws
    WHERE interval_id > (SELECT max(interval_id) FROM iv WHERE interval_end < {CUTOFF})""",
    "retention_log": ctes(LOG) + f"SELECT * FROM log WHERE log_timestamp >= {CUTOFF}",
    "retention_throttled": ctes(
        *AGING,
        (
            "gone",
            "SELECT query_id, interval_id FROM qrs WHERE query_id IN (SELECT query_id FROM candidates) "
            "ORDER BY query_id, interval_id LIMIT 20",
        ),
    )
    + """
    SELECT * FROM qrs
    WHERE (query_id, interval_id) NOT IN (SELECT (query_id, interval_id) FROM gone)""",
    "gather_run": ctes(
        *HANDLE_PARTS, XML, STATEMENTS, MEASURED, INTERVALS, HOURS, BY_TYPE, WAIT_SNAP,
        (
            "captured",
            """
            SELECT s.plan_handle FROM new_handles h JOIN statements s ON s.plan_handle = h.plan_handle
            JOIN xml x ON x.plan_handle = h.plan_handle
            WHERE query_plan IS NOT NULL AND NOT (query_plan LIKE '%</ShowPlanXML>'
                AND regexp_matches(query_plan, 'ColumnReference Schema="\\[telemetry\\]"'))
        """,
        ),
        (
            "captured_queries",
            f"""
            SELECT s.query_hash FROM captured p JOIN statements s ON s.plan_handle = p.plan_handle
            JOIN documents d ON {hexid('d.doc_id')} = s.sql_handle
        """,
        ),
    )
    + """
    SELECT 'activity_log' AS table_name, CAST(6 AS BIGINT) AS row_count
    UNION ALL SELECT 'intervals', 1
    UNION ALL SELECT 'plan_dbid', count(*) FROM new_handles
    UNION ALL SELECT 'plans', count(*) FROM captured
    UNION ALL SELECT 'queries', count(*) FROM captured_queries
    UNION ALL SELECT 'query_runtime_stats', count(*) FROM captured_queries
    UNION ALL SELECT 'wait_stats', count(*) FROM wsnap WHERE interval_id = (SELECT max(interval_id) FROM iv)""",
    "stream_runtime_delta": ctes(*HISTORY)
    + "SELECT * FROM qrs WHERE (query_id, interval_id) NOT IN "
    "(SELECT (query_id, max(interval_id)) FROM snap GROUP BY query_id)",
    "stream_waits_delta": ctes(*WAITS) + "SELECT * FROM ws WHERE is_delta",
    "stream_interval_totals": ctes(MEASURED) + """
    SELECT interval_start, interval_start + INTERVAL 1 HOUR AS interval_end, event_type, count(*) AS events,
        CAST(sum(elapsed_time) AS BIGINT) AS total
    FROM (SELECT *, date_trunc('hour', ts) AS interval_start FROM measured)
    GROUP BY 1, 2, 3
    HAVING interval_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
}


def charted(name: str, keys: str, values: tuple[str, ...]) -> str:
    """Sums that a chart takes over a report."""
    sums = ", ".join(f"CAST(sum({v}) AS BIGINT) AS {v}" for v in values)
    return f"SELECT {keys}, {sums} FROM ({ORACLE[name]}) GROUP BY ALL"


STRICT = ("qrs", f"SELECT * FROM ({delta_body()}) WHERE is_delta")
for report in ("top_avg_duration", "worker_time"):
    ORACLE[f"{report}_strict"] = ORACLE[report].replace(f"{DELTA[0]} AS ({DELTA[1]})", f"{STRICT[0]} AS ({STRICT[1]})")
    assert ORACLE[f"{report}_strict"] != ORACLE[report]
ORACLE["cleanup_stored"] = ORACLE["retention_stats"]
ORACLE["item_count_chart"] = charted("item_count", "database", ("queries", "plans", "runtime_stats"))
ORACLE["io_chart"] = charted("io", "time_date, database_name", ("avg_logical_reads", "avg_logical_writes"))
ORACLE["elapsed_time_chart"] = charted("elapsed_time", "time_date, database_name", ("avg_elapsed_time",))
ORACLE["wait_time_chart"] = charted("wait_time_per_interval", "time_date", ("total_wait_time", "waiting_tasks"))
ORACLE["top3_waits_chart"] = charted("top3_waits", "time_date, wait_type", ("wait_time_ms",))

# Columns of the test tables by kind: i and f have 4 bytes, l 8 (also doubles and times), s is text, v a list of floats.
TABLE_KINDS = {
    "region": "r_regionkey i, r_name s",
    "nation": "n_nationkey i, n_name s, n_regionkey i",
    "customer": "c_custkey l, c_name s, c_nationkey i, c_acctbal l, c_mktsegment s",
    "supplier": "s_suppkey l, s_name s, s_nationkey i, s_acctbal l",
    "part": "p_partkey l, p_name s, p_brand s, p_type s, p_size i, p_retailprice l",
    "orders": "o_orderkey l, o_custkey l, o_orderstatus s, o_totalprice l, o_orderdate l, o_orderpriority s",
    "lineitem": "l_orderkey l, l_partkey l, l_suppkey l, l_linenumber i, l_quantity l, l_extendedprice l, "
    "l_discount l, l_tax l, l_returnflag s, l_linestatus s, l_shipdate l",
    "events": "event_id l, ts l, user_id l, event_type s, value l, props s",
    "documents": "doc_id l, text s, lang s, source s, n_chars l",
    "embeddings": "vec_id l, embedding v, label i",
    "pages": "page_id l, url s, html s",
    "benchmark": "item_id l, text s",
    "labels": "doc_id l, quality i, toxic i",
    "conversations": "conv_id l, turn l, role s, text s",
}


def _content(table: str, columns: str) -> str:
    size = {"i": "4", "l": "8", "s": "strlen({0})", "v": "4 * len({0})"}
    parts = [c.split() for c in columns.split(", ")]
    total = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {size[k].format(c)} END" for c, k in parts)
    return f"SELECT '{table}' AS table_name, count(*) AS row_count, CAST(ceil(sum({total}) / 1024) AS BIGINT) AS size_kb FROM {table}"


CONTENTS = (
    "contents",
    "SELECT table_name, CAST(table_id AS INTEGER) AS table_id, 'U' AS table_type, row_count, size_kb FROM (SELECT unnest(["
    + ", ".join(f"'{t}'" for t in TABLE_KINDS)
    + ", 'unstored']) AS table_name, unnest(range(1, 16)) AS table_id) LEFT JOIN ("
    + " UNION ALL ".join(_content(t, c) for t, c in TABLE_KINDS.items())
    + ") USING (table_name)",
)
ORACLE["content_catalog"] = ctes(CONTENTS) + "SELECT * FROM contents"
ORACLE["storage_size"] = ctes(CONTENTS) + "SELECT table_name, size_kb FROM contents WHERE size_kb IS NOT NULL"
ORACLE["size_budget"] = ctes(CONTENTS) + """
SELECT coalesce(102400 > sum(size_kb), false) AS within_budget, CAST(sum(size_kb) AS BIGINT) AS used_kb FROM contents"""
