"""From raw server frames to new plans and new queries.

Every step is incremental: handles, plans and queries already in the store are
dropped before anything wide (plan documents, batch texts) is joined.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import StoreConfig
from tidemark.functions.plan_xml import optimization_level, touches_schema
from tidemark.functions.text import fingerprint, utf16_slice
from tidemark.functions.times import at
from tidemark.operators.relational import drop_listed, keep_listed

# The kind of cache entry that holds a plan, and the attributes read of it.
COMPILED_PLAN = "Compiled Plan"
DATABASE_ATTRIBUTE = "dbid"
PLAN_ATTRIBUTES = ("dbid", "sql_handle")


def compiled_plans(cache: DataFrame, min_uses: int = 2) -> DataFrame:
    """Cache entries that hold a plan and were used often enough to be worth keeping."""
    return cache.filter((F.col("cacheobjtype") == COMPILED_PLAN) & (F.col("usecounts") >= min_uses))


def plan_attributes(cache: DataFrame, attributes: DataFrame) -> DataFrame:
    """Attribute rows of each plan; a plan without attributes keeps one row of NULLs."""
    return cache.select("plan_handle").join(attributes, "plan_handle", "left")


def pivot_attributes(rows: DataFrame, wanted: Sequence[str] = PLAN_ATTRIBUTES) -> DataFrame:
    """One row per plan with a column per wanted attribute; other attributes are ignored."""
    pivoted = rows.groupBy("plan_handle").pivot("attribute", list(wanted)).agg(F.max("value"))
    if DATABASE_ATTRIBUTE in wanted:
        pivoted = pivoted.withColumn(DATABASE_ATTRIBUTE, F.col(DATABASE_ATTRIBUTE).cast("int"))
    return pivoted


def monitored_list(config: StoreConfig, monitored: DataFrame) -> DataFrame:
    """Databases to watch: the one configured in classic mode, else the kept list."""
    if config.mode == "classic":
        spark = monitored.sparkSession
        return spark.createDataFrame([(config.classic_database,)], "database_name string")
    return monitored


def monitored_ids(monitored: DataFrame, databases: DataFrame) -> DataFrame:
    """Ids and names of the watched databases; names are compared without regard to case."""
    folded = databases.withColumn("_name", F.lower("database_name"))
    listed = monitored.select(F.lower("database_name").alias("_name"))
    return keep_listed(folded, listed, "_name").select("dbid", "database_name")


def monitored_plans(plans: DataFrame, monitored: DataFrame, databases: DataFrame) -> DataFrame:
    """Pivoted plans (with ``dbid``) that belong to a watched database."""
    return keep_listed(plans, monitored_ids(monitored, databases), "dbid")


def new_plan_handles(
    cache: DataFrame,
    attributes: DataFrame,
    seen: DataFrame,
    monitored: DataFrame,
    databases: DataFrame,
    min_uses: int = 2,
) -> DataFrame:
    """``(plan_handle, dbid)`` of plans never seen before in a watched database.

    Only the database attribute takes part, so the other attribute rows stay in
    the scan; a plan without it cannot be in a watched database.
    """
    cached = drop_listed(compiled_plans(cache, min_uses).select("plan_handle"), seen, "plan_handle")
    database = attributes.filter(F.col("attribute") == DATABASE_ATTRIBUTE)
    owned = plan_attributes(cached, database).groupBy("plan_handle").agg(
        F.max(F.col("value").cast("int")).alias(DATABASE_ATTRIBUTE)
    )
    return monitored_plans(owned, monitored, databases).select("plan_handle", "dbid")


def new_plans(
    handles: DataFrame,
    cache: DataFrame,
    stats: DataFrame,
    xml: DataFrame,
    known: DataFrame,
    databases: DataFrame,
    as_of: datetime,
    dedupe_batch: bool = False,
) -> DataFrame:
    """One plan row per statement of each new handle, unless its fingerprint is known.

    A handle with several statements gives several rows, and equal fingerprints
    inside one batch are all kept; ``dedupe_batch`` keeps the first of each.
    The documents are joined last, to rows that are certain to be new.
    """
    statements = stats.select(
        "plan_handle",
        fingerprint(F.col("query_hash"), F.col("query_plan_hash")).alias("plan_fingerprint"),
    )
    fresh = drop_listed(
        keep_listed(statements, handles, "plan_handle"), known, "plan_fingerprint"
    )
    entries = cache.filter(F.col("cacheobjtype") == COMPILED_PLAN).select(
        "plan_handle",
        F.col("refcounts").alias("plan_refcounts"),
        F.col("usecounts").alias("plan_usecounts"),
        F.col("size_in_bytes").alias("plan_sizeinbytes"),
        F.col("cacheobjtype").alias("plan_type"),
        F.col("objtype").alias("plan_objecttype"),
    )
    names = databases.select("dbid", F.col("database_name").alias("plan_database"))
    plans = handles.join(names, "dbid", "left").join(entries, "plan_handle").join(fresh, "plan_handle")
    if dedupe_batch:
        w = Window.partitionBy("plan_fingerprint").orderBy("plan_handle", "plan_usecounts")
        plans = plans.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    documents = xml.filter(F.col("query_plan").isNotNull())
    return plans.join(documents, "plan_handle").select(
        "plan_fingerprint",
        "plan_handle",
        at(as_of).alias("plan_firstfound"),
        "plan_database",
        "plan_refcounts",
        "plan_usecounts",
        "plan_sizeinbytes",
        "plan_type",
        "plan_objecttype",
        F.col("query_plan").alias("plan_executionplan"),
    )


def annotate_plans(plans: DataFrame) -> DataFrame:
    """Fill in the optimisation level of plans not read before, and mark them as read.

    The marker is tested first, so no document is parsed twice.
    """
    unread = F.col("xml_processed") == 0
    level = optimization_level(F.col("plan_executionplan"))
    has_document = F.col("plan_executionplan").isNotNull()
    out = {
        "plan_optimization": F.when(unread & has_document, level).otherwise(F.col("plan_optimization")),
        "xml_processed": F.when(unread & has_document, F.lit(1)).otherwise(F.col("xml_processed")),
    }
    return plans.select(*[out[c].alias(c) if c in out else F.col(c) for c in plans.columns])


def new_queries(
    plans: DataFrame, stats: DataFrame, text: DataFrame, known: DataFrame, match_hash: bool = True
) -> DataFrame:
    """Statements of the stored plans that are not known as queries yet.

    Plans and statements meet on handle and fingerprint, so a handle with n plan
    rows and n statements gives n queries.  Without ``match_hash`` they meet on
    the handle alone, which gives n * n, so statements without a batch text go
    before they are paired.  The batch texts are joined to new rows only.
    """
    statements = stats.select(
        "plan_handle",
        "sql_handle",
        "query_hash",
        "query_plan_hash",
        "statement_start_offset",
        "statement_end_offset",
        "creation_time",
    )
    owners = plans.select("plan_id", "plan_handle", "plan_fingerprint")
    if match_hash:
        statements = statements.withColumn(
            "plan_fingerprint", fingerprint(F.col("query_hash"), F.col("query_plan_hash"))
        )
        paired = owners.join(statements, ["plan_handle", "plan_fingerprint"])
    else:
        paired = owners.join(keep_listed(statements, text, "sql_handle"), "plan_handle")
    tagged = paired.withColumn(
        "query_plan_fingerprint", fingerprint(F.col("plan_fingerprint"), F.col("query_hash"))
    )
    fresh = drop_listed(tagged, known, "query_plan_fingerprint")
    start, end = F.col("statement_start_offset"), F.col("statement_end_offset")
    return fresh.join(text.select("sql_handle", "text"), "sql_handle").select(
        "plan_id",
        "query_hash",
        "query_plan_fingerprint",
        utf16_slice(F.col("text"), start, end).alias("query_statement_text"),
        start.alias("query_statement_start_offset"),
        end.alias("query_statement_end_offset"),
        F.col("creation_time").alias("query_creation_time"),
    )


def self_plans(plans: DataFrame, schema: str) -> DataFrame:
    """Ids of plans whose document reads the store's own schema."""
    return plans.filter(touches_schema(F.col("plan_executionplan"), schema)).select("plan_id")


def drop_self(
    queries: DataFrame, plans: DataFrame, schema: str
) -> tuple[DataFrame, DataFrame]:
    """Queries and plans without the store's own traffic; queries go with their plan.

    Whether a plan row goes depends on its document alone, so plans are
    filtered in place and only queries need a join.
    """
    own = touches_schema(F.col("plan_executionplan"), schema)
    flagged = plans.filter(own).select("plan_id")
    return queries.join(flagged, "plan_id", "left_anti"), plans.filter(~own)
