"""Folding raw counters into one snapshot row per query or wait type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import METRICS, WAIT_COUNTERS

#: How a statement's counters are found again: by text position, shape and birth.
MATCH = {
    "query_hash": "query_hash",
    "query_statement_start_offset": "statement_start_offset",
    "query_statement_end_offset": "statement_end_offset",
    "query_creation_time": "creation_time",
}


#: Intervals of a query that one task folds together.
BLOCK = 1024


def match_stats(
    queries: DataFrame, stats: DataFrame, match_creation_time: bool = True, partitions: int | None = None
) -> DataFrame:
    """Statement counters tagged with the ``query_id`` they belong to.

    A recompiled statement gets a new creation time and no longer matches its
    query; ``match_creation_time=False`` matches it all the same.  ``partitions``
    deals the counters over so many tasks before they are joined.
    """
    pairs = {
        q: s for q, s in MATCH.items() if match_creation_time or q != "query_creation_time"
    }
    keys = queries.select("query_id", *[F.col(q).alias(s) for q, s in pairs.items()])
    if partitions is not None:
        stats = stats.repartition(partitions, *pairs.values())
    return stats.join(keys, list(pairs.values()))


def fold_aggregates() -> list[Column]:
    """One aggregate per snapshot column; averages start at 0 until differenced."""
    out = [
        F.min("creation_time").alias("creation_time"),
        F.max("last_execution_time").alias("last_execution_time"),
        F.sum("execution_count").alias("execution_count"),
    ]
    for m in METRICS:
        out += [
            F.sum(f"total_{m}").alias(f"total_{m}"),
            F.sum(f"last_{m}").alias(f"last_{m}"),
            F.min(f"min_{m}").alias(f"min_{m}"),
            F.max(f"max_{m}").alias(f"max_{m}"),
            F.lit(0).cast("long").alias(f"avg_{m}"),
        ]
    return out


def fold_snapshot(matched: DataFrame, *more: str) -> DataFrame:
    """Sum the plan handles of each query: one row per query and interval, and value of the columns ``more``."""
    return matched.groupBy("query_id", "interval_id", *more).agg(*fold_aggregates())


def runtime_snapshot(
    queries: DataFrame, stats: DataFrame, match_creation_time: bool = True, partitions: int | None = None
) -> DataFrame:
    """Snapshot rows for every known query.  ``stats`` carries an ``interval_id``.

    ``partitions`` is for counters of a long history, too many for the session's
    number of shuffle partitions.  They are then folded where they were matched,
    and dealt by query and block of intervals to be folded to the end.
    """
    matched = match_stats(queries, stats, match_creation_time, partitions)
    if partitions is None:
        return fold_snapshot(matched)
    # By what the matched rows are dealt by already, so this fold shuffles nothing.
    here = {f"_{s}": F.col(s) for q, s in MATCH.items() if match_creation_time or q != "query_creation_time"}
    folded = fold_snapshot(matched.withColumns(here), *here).drop(*here)
    block = F.call_function("div", F.col("interval_id"), F.lit(BLOCK))
    dealt = folded.withColumn("_block", block).repartition(partitions, "query_id", "_block")
    return fold_snapshot(dealt, "_block").drop("_block")


def wait_snapshot(waits: DataFrame, interval_id: int | Column | None = None) -> DataFrame:
    """Wait counters that have counted anything, tagged with an interval.

    Without ``interval_id`` the frame is taken to carry the column already.
    """
    if interval_id is not None:
        tag = interval_id if isinstance(interval_id, Column) else F.lit(interval_id)
        waits = waits.withColumn("interval_id", tag.cast("int"))
    return waits.filter((F.col("waiting_tasks_count") > 0) & (F.col("wait_time_ms") > 0)).select(
        "interval_id", "wait_type", *WAIT_COUNTERS
    )
