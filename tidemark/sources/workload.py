"""A telemetry workload derived from the test tables.

Users of ``events`` play the queries, their event types the plan handles, and
hours the intervals; parts and their line items play cached plans and
statements.  Everything is derived by Spark from the given tables.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import fingerprint
from tidemark.functions.times import at
from tidemark.operators.deltas import runtime_delta, wait_delta
from tidemark.operators.intervals import open_close_intervals
from tidemark.operators.snapshots import fold_snapshot, wait_snapshot
from tidemark.schemas import METRICS, QUERY_STATS
from tidemark.store import Inputs, Store

# Parameters of the projection.
EPOCH = datetime(2024, 1, 1)
AS_OF = datetime(2024, 1, 30, 23)
EVICT_HOURS = 72
RETENTION_DAYS = 1
DAY = timedelta(hours=24)
EIGHT_DAYS = timedelta(hours=192)
OWN_SCHEMA = "telemetry"
NAMESPACE = "urn:example:showplan"
MONITORED_REGIONS = (1, 3)


def hex_id(number: Column) -> Column:
    """A number as an 8-byte handle or hash."""
    return F.unhex(F.lpad(F.hex(number), 16, "0"))


def hour_of(ts: Column) -> Column:
    """Hours since the epoch of the projection."""
    return F.timestamp_diff("HOUR", at(EPOCH), ts)


# Counters that servers of every version report and the versioned sample carries.
SERVER_VERSIONS = ("9.0.4035.0", "10.0.1600.0", "10.50.2500.0", "12.0.2000.8", "13.0.1601.5")


#: Events whose counters one task spreads over the runs that find them, about ten rows each and at most 72.
EVENTS_PER_TASK = 40_000

#: Schemas of tables seen before, by path, so that a footer is read once per process.
_SCHEMAS: dict[str, T.StructType] = {}


class Workload:
    """Lazily derived frames over one folder of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._tables: dict[str, DataFrame] = {}
        self._events: int | None = None

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            path = f"{self.sf_dir}/{name}.parquet"
            reader = self.spark.read
            if path in _SCHEMAS:
                reader = reader.schema(_SCHEMAS[path])
            self._tables[name] = reader.parquet(path)
            _SCHEMAS[path] = self._tables[name].schema
        return self._tables[name]

    def width(self) -> int:
        """Partitions for counters as the runs find them: more with more events, so that no task grows.

        Rows are counted from the footers of the files.
        """
        if self._events is None:
            self._events = self.table("events").count()
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self._events // EVENTS_PER_TASK))

    # -- time ---------------------------------------------------------------

    def runs(self) -> DataFrame:
        """One collection run at the start of every hour the events span."""
        span = self.table("events").agg(hour_of(F.max("ts")).alias("last"))
        hours = span.select(F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("h"))
        return hours.select(
            (F.col("h") + 1).cast("int").alias("run_id"),
            F.timestamp_add("HOUR", F.col("h"), at(EPOCH)).alias("run_time"),
        )

    def intervals(self) -> DataFrame:
        return open_close_intervals(self.runs())

    def last_hour(self) -> Column:
        """Hour of the newest interval, as a scalar expression."""
        return self.table("events").agg(hour_of(F.max("ts")).alias("last")).scalar()

    # -- counters -----------------------------------------------------------

    def _measured(self) -> DataFrame:
        """Events with the metrics each one adds to its counters."""
        elapsed = F.round(F.col("value") * 100).cast("long")
        return self.table("events").select(
            "user_id",
            "event_type",
            "event_id",
            "ts",
            hour_of(F.col("ts")).alias("h"),
            elapsed.alias("elapsed_time"),
            F.get_json_object("props", "$.k").cast("long").alias("rows"),
            F.call_function("div", elapsed, F.lit(2)).alias("worker_time"),
            (F.col("event_id") % 7).alias("physical_reads"),
            (F.col("event_id") % 101).alias("logical_reads"),
            (F.col("event_id") % 13).alias("logical_writes"),
        )

    def _running(self) -> DataFrame:
        """Counters per plan handle as they stand after each of its active hours, and how long they stay so.

        Events are summed per hour first.  A running total over the hours of a
        handle then gives its counters, which every run sees until the next
        active hour or until the handle is evicted.
        """
        hourly = self._measured().groupBy("user_id", "event_type", "h").agg(
            F.count(F.lit(1)).alias("n"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
            *[F.sum(m).alias(f"total_{m}") for m in METRICS],
            *[F.max_by(m, "ts").alias(f"last_{m}") for m in METRICS],
            *[F.min(m).alias(f"min_{m}") for m in METRICS],
            *[F.max(m).alias(f"max_{m}") for m in METRICS],
        )
        # By user, so that the windows, the fold per query and the deltas share this shuffle.
        # The number is given because each row grows into many below: judged by their size
        # before that, adaptive execution would merge the partitions into too few.
        hourly = hourly.repartition(self.width(), "user_id")
        user = Window.partitionBy("user_id")
        handle = Window.partitionBy("user_id", "event_type").orderBy("h")
        so_far = handle.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return hourly.withColumn("creation_time", F.min("first_ts").over(user)).select(
            "user_id",
            "event_type",
            "h",
            F.least(
                F.coalesce(F.lead("h").over(handle), self.last_hour()),
                F.col("h") + EVICT_HOURS,
                self.last_hour(),
            ).alias("until"),
            "creation_time",
            F.col("last_ts").alias("last_execution_time"),
            F.sum("n").over(so_far).alias("execution_count"),
            *[F.sum(f"total_{m}").over(so_far).alias(f"total_{m}") for m in METRICS],
            *[F.col(f"last_{m}") for m in METRICS],
            *[F.min(f"min_{m}").over(so_far).alias(f"min_{m}") for m in METRICS],
            *[F.max(f"max_{m}").over(so_far).alias(f"max_{m}") for m in METRICS],
        )

    def query_stats(self, since: Column | None = None) -> DataFrame:
        """Cumulative counters per plan handle as each collection run finds them, from interval ``since`` on."""
        return _counters(self._running(), "user_id", since=since)

    def keyed_query_stats(self) -> DataFrame:
        """The same with the query hash, as ``match_stats`` wants it."""
        shapes = self.table("customer").select(
            F.col("c_custkey").alias("user_id"), hex_id(F.col("c_nationkey")).alias("query_hash")
        )
        # Joined to the active hours, of which there are fewer than of runs that see them.
        return _counters(self._running().join(shapes, "user_id"), "query_hash")

    def runtime_snapshots(self, since: Column | None = None) -> DataFrame:
        """Counters folded to one row per query, from interval ``since`` on; a user's id is the id of the query."""
        return fold_snapshot(self.query_stats(since).withColumnRenamed("user_id", "query_id"))

    def runtime_history(self, **options) -> DataFrame:
        """``runtime_delta`` of all snapshots, dealt over as many tasks as they need."""
        return runtime_delta(self.runtime_snapshots(), partitions=self.width(), **options)

    def wait_counters(self) -> DataFrame:
        """Cumulative wait counters as each collection run finds them; never evicted."""
        wait_type = F.concat("event_type", F.lit("_"), (F.col("user_id") % 20).cast("string"))
        hourly = (
            self._measured()
            .groupBy(wait_type.alias("wait_type"), "h")
            .agg(
                F.count(F.lit(1)).alias("n"),
                F.sum("elapsed_time").alias("total"),
                F.max("elapsed_time").alias("longest"),
                F.sum(F.col("event_id") % 11).alias("signal"),
            )
        )
        ordered = Window.partitionBy("wait_type").orderBy("h")
        so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        running = hourly.select(
            "wait_type",
            "h",
            F.coalesce(F.lead("h").over(ordered), self.last_hour()).alias("until"),
            F.sum("n").over(so_far).alias("waiting_tasks_count"),
            F.sum("total").over(so_far).alias("wait_time_ms"),
            F.max("longest").over(so_far).alias("max_wait_time_ms"),
            F.sum("signal").over(so_far).alias("signal_wait_time_ms"),
        )
        return _seen_by_runs(running).drop("h", "until")

    # -- store tables -------------------------------------------------------

    def plans(self) -> DataFrame:
        """One plan per customer."""
        key = F.col("c_custkey")
        return self.table("customer").select(
            key.alias("plan_id"),
            fingerprint(hex_id(F.col("c_nationkey")), hex_id(key % 4)).alias("plan_fingerprint"),
            F.col("c_mktsegment").alias("plan_database"),
            _object_type(key).alias("plan_objecttype"),
        )

    def queries(self) -> DataFrame:
        """One query per customer, with the id of its plan."""
        key = F.col("c_custkey")
        return self.table("customer").select(
            key.alias("query_id"), key.alias("plan_id"), hex_id(F.col("c_nationkey")).alias("query_hash")
        )

    def queries_with_origin(self) -> DataFrame:
        """Queries with text offsets and creation time (that of the first event)."""
        born = self.table("events").groupBy("user_id").agg(F.min("ts").alias("_born"))
        start, end = _offsets(F.col("query_id"))
        queries = self.queries()
        return queries.join(born, F.col("query_id") == F.col("user_id"), "left").select(
            *queries.columns,
            start.alias("query_statement_start_offset"),
            end.alias("query_statement_end_offset"),
            F.coalesce("_born", at(EPOCH)).alias("query_creation_time"),
        )

    def excluded_queries(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").filter(key % 10 == 3).select(key.alias("query_id"))

    def wait_type_filter(self) -> DataFrame:
        """The error waits of the first five groups."""
        group = F.col("user_id") % 20
        errors = self.table("events").filter((F.col("event_type") == "error") & (group < 5))
        wait_type = F.concat("event_type", F.lit("_"), group.cast("string"))
        return errors.select(wait_type.alias("wait_type")).distinct()

    def activity_log(self) -> DataFrame:
        """Conversations as runs, turns as messages."""
        return self.table("conversations").select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("log_id"),
            F.col("conv_id").alias("log_run_id"),
            F.timestamp_add("HOUR", F.col("conv_id") * 71 % 720, at(EPOCH)).alias("log_timestamp"),
            F.col("text").alias("log_message"),
        )

    def store(self, *names: str) -> Store:
        """History as the reports read it; only the named tables if any are named."""
        builders = {
            "activity_log": self.activity_log,
            "monitored_databases": self.monitored_databases,
            "intervals": self.intervals,
            "plan_dbid": self.seen_plans,
            "plans": self.plans,
            "queries": self.queries,
            "excluded_queries": self.excluded_queries,
            "query_runtime_stats": self.runtime_history,
            "wait_stats": lambda: wait_delta(wait_snapshot(self.wait_counters())),
            "wait_type_filter": self.wait_type_filter,
        }
        return Store(**{name: builders[name]() for name in names or builders})

    def aging_queries(self) -> DataFrame:
        """Queries for retention: two of them share a plan."""
        key = F.col("c_custkey")
        return self.table("customer").select(key.alias("query_id"), (key - key % 2).alias("plan_id"))

    def aging_plans(self) -> DataFrame:
        """The plans of ``aging_queries``."""
        return self.plans().filter(F.col("plan_id") % 2 == 0)

    # -- collection inputs --------------------------------------------------

    def cached_plans(self) -> DataFrame:
        """One cache entry per part."""
        key, size = F.col("p_partkey"), F.col("p_size")
        return self.table("part").select(
            hex_id(key).alias("plan_handle"),
            F.when(key % 4 == 0, "Parse Tree").otherwise("Compiled Plan").alias("cacheobjtype"),
            _object_type(key).alias("objtype"),
            size.alias("usecounts"),
            (size % 4 + 1).alias("refcounts"),
            (size * 1024).alias("size_in_bytes"),
        )

    def plan_attributes(self) -> DataFrame:
        """Three attributes per part; every eleventh part has none."""
        def row(name: str, value: Column) -> Column:
            return F.struct(F.lit(name).alias("attribute"), value.cast("string").alias("value"))

        rows = F.array(
            row("dbid", F.col("p_size") % 5),
            row("sql_handle", F.col("p_brand")),
            row("set_options", F.col("p_type")),
        )
        return (
            self.table("part")
            .filter(F.col("p_partkey") % 11 != 0)
            .select(hex_id(F.col("p_partkey")).alias("plan_handle"), F.inline(rows))
        )

    def databases(self) -> DataFrame:
        return self.table("region").select(
            F.col("r_regionkey").alias("dbid"), F.col("r_name").alias("database_name")
        )

    def monitored_databases(self) -> DataFrame:
        watched = self.databases().filter(F.col("dbid").isin(*MONITORED_REGIONS))
        return watched.select("database_name")

    def seen_plans(self) -> DataFrame:
        """The ledger: every fifth part."""
        return (
            self.table("part")
            .filter(F.col("p_partkey") % 5 == 0)
            .select(hex_id(F.col("p_partkey")).alias("plan_handle"), (F.col("p_size") % 5).alias("dbid"))
        )

    def plan_xml(self) -> DataFrame:
        """A plan document per part: with or without a level, some cut short, some missing."""
        key, size = F.col("p_partkey"), F.col("p_size")
        level = (
            F.when(size % 5 == 0, "")
            .when(size % 2 == 0, ' StatementOptmLevel="TRIVIAL"')
            .otherwise(' StatementOptmLevel="FULL"')
        )
        schema = F.when(key % 17 == 0, OWN_SCHEMA).otherwise("dbo")
        document = F.concat(
            F.lit(f'<ShowPlanXML xmlns="{NAMESPACE}"><BatchSequence><Batch><Statements><StmtSimple'),
            level,
            F.lit('><ColumnReference Schema="['),
            schema,
            F.lit(']" Column="'),
            key.cast("string"),
            F.lit('"/></StmtSimple></Statements></Batch></BatchSequence></ShowPlanXML>'),
        )
        cut = F.when(key % 23 == 0, F.substring(document, F.lit(1), F.length(document) - 20))
        whole = F.when(key % 29 != 0, F.coalesce(cut, document))
        return self.table("part").select(hex_id(key).alias("plan_handle"), whole.alias("query_plan"))

    def plan_documents(self) -> DataFrame:
        """Parts as stored plans with their document, none of them read yet."""
        xml = self.plan_xml().filter(F.col("query_plan").isNotNull())
        return xml.select(
            F.conv(F.hex("plan_handle"), 16, 10).cast("long").alias("plan_id"),
            F.col("query_plan").alias("plan_executionplan"),
            F.lit(None).cast("string").alias("plan_optimization"),
            F.lit(0).alias("xml_processed"),
        )

    def statements(self) -> DataFrame:
        """Statement counters of the cached plans: one statement per line number of a part."""
        line = F.col("l_linenumber")
        elapsed = F.round(F.col("l_extendedprice") * 100).cast("long")
        measured = self.table("lineitem").select(
            "l_partkey",
            "l_linenumber",
            "l_shipdate",
            elapsed.alias("elapsed_time"),
            F.col("l_quantity").cast("long").alias("rows"),
            F.call_function("div", elapsed, F.lit(2)).alias("worker_time"),
            (F.col("l_orderkey") % 7).alias("physical_reads"),
            (F.col("l_orderkey") % 101).alias("logical_reads"),
            (F.col("l_orderkey") % 13).alias("logical_writes"),
        )
        folded = measured.groupBy("l_partkey", "l_linenumber").agg(
            F.min("l_shipdate").alias("creation_time"),
            F.max("l_shipdate").alias("last_execution_time"),
            F.count(F.lit(1)).alias("execution_count"),
            *[F.sum(m).alias(f"total_{m}") for m in METRICS],
            *[F.max(m).alias(f"last_{m}") for m in METRICS],
            *[F.min(m).alias(f"min_{m}") for m in METRICS],
            *[F.max(m).alias(f"max_{m}") for m in METRICS],
        )
        start = (line - 1) * 20
        return folded.select(
            "l_partkey",
            "l_linenumber",
            hex_id(F.col("l_partkey")).alias("plan_handle"),
            hex_id(F.col("l_partkey")).alias("sql_handle"),
            hex_id(F.col("l_partkey") * 8 + line).alias("query_hash"),
            hex_id(F.col("l_partkey") % 97).alias("query_plan_hash"),
            start.alias("statement_start_offset"),
            F.when(line == 7, -1).otherwise(start + 40).alias("statement_end_offset"),
            "creation_time",
            "last_execution_time",
            "execution_count",
            *[f"{s}_{m}" for m in METRICS for s in ("total", "last", "min", "max")],
        )

    def known_plans(self) -> DataFrame:
        """Fingerprints already stored: the statements of every seventh part."""
        known = self.statements().filter(F.col("l_partkey") % 7 == 0)
        return known.select(
            fingerprint(F.col("query_hash"), F.col("query_plan_hash")).alias("plan_fingerprint")
        )

    def statement_plans(self) -> DataFrame:
        """A stored plan row per statement of each part."""
        return self.statements().select(
            (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("plan_id"),
            "plan_handle",
            fingerprint(F.col("query_hash"), F.col("query_plan_hash")).alias("plan_fingerprint"),
        )

    def known_queries(self) -> DataFrame:
        """Query fingerprints already stored: the statements of every thirteenth part."""
        known = self.statements().filter(F.col("l_partkey") % 13 == 0)
        return known.select(
            fingerprint(F.col("query_hash"), F.col("query_plan_hash"), F.col("query_hash")).alias(
                "query_plan_fingerprint"
            )
        )

    def sql_text(self) -> DataFrame:
        """Documents as batch texts."""
        return self.table("documents").select(hex_id(F.col("doc_id")).alias("sql_handle"), "text")


    def inputs(self) -> Inputs:
        """What one collection run at the newest interval reads."""
        newest = F.col("interval_id") == self.last_hour() + 1
        return Inputs(
            cached_plans=self.cached_plans(),
            plan_attributes=self.plan_attributes(),
            plan_xml=self.plan_xml(),
            query_stats=self.statements().drop("l_partkey", "l_linenumber"),
            sql_text=self.sql_text(),
            wait_counters=self.wait_counters().filter(newest).drop("interval_id"),
            databases=self.databases(),
        )

    def versioned_stats(self) -> DataFrame:
        """Parts as statement counters from servers of five versions, every column filled."""
        key, size = F.col("p_partkey"), F.col("p_size").cast("long")

        def value(i: int, kind: T.DataType) -> Column:
            if isinstance(kind, T.BinaryType):
                return hex_id(key % (70 + i))
            if isinstance(kind, T.TimestampNTZType):
                return F.timestamp_add("HOUR", key % (70 + i), at(EPOCH))
            return size * (i + 1) if isinstance(kind, T.LongType) else (key % (7 + i)).cast("int")

        return self.table("part").select(
            key,
            F.get(F.array(*[F.lit(v) for v in SERVER_VERSIONS]), (key % len(SERVER_VERSIONS)).cast("int")).alias("version"),
            *[value(i, f.dataType).alias(f.name) for i, f in enumerate(QUERY_STATS.fields)],
        )


def _seen_by_runs(running: DataFrame, since: Column | None = None) -> DataFrame:
    """A row per run that finds the counters as they stood after hour ``h``, up to ``until``.

    Runs before interval ``since`` are left out before rows are made for them.
    """
    seen = running.filter(F.col("until") > F.col("h"))
    first, last = (F.col("h") + 2).cast("int"), (F.col("until") + 1).cast("int")
    if since is not None:
        seen = seen.filter(last >= since)
        first = F.greatest(first, since.cast("int"))
    return seen.withColumn("interval_id", F.explode(F.sequence(first, last)))


def _counters(running: DataFrame, *more: str, since: Column | None = None) -> DataFrame:
    """Statement counters as every run finds them from interval ``since`` on, and the columns ``more``."""
    return _seen_by_runs(running, since).select(
        F.concat(hex_id(F.col("user_id")), F.encode("event_type", "UTF-8")).alias("plan_handle"),
        *more,
        *_offsets(F.col("user_id")),
        "interval_id",
        "creation_time",
        "last_execution_time",
        "execution_count",
        *[f"{s}_{m}" for m in METRICS for s in ("total", "last", "min", "max")],
    )


def _offsets(key: Column) -> list[Column]:
    start = (key % 10).cast("int") * 2
    return [
        start.alias("statement_start_offset"),
        F.when(key % 3 == 0, F.lit(-1)).otherwise(start + 100).alias("statement_end_offset"),
    ]


def _object_type(key: Column) -> Column:
    return F.when(key % 3 == 0, "Adhoc").when(key % 3 == 1, "Prepared").otherwise("Proc")
