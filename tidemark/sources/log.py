"""The activity log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.times import at
from tidemark.schemas import ACTIVITY_LOG

NOT_ACTIVE = "Collection is not active; run skipped"
NOTHING_MONITORED = "No databases are monitored; run skipped"
STORE_FULL = "The store is full; configured maximum size (MB): {}"
STARTED = "Collection started"
FINISHED = "Collection finished"
CLEANED = "Cleanup of expired history executed"


def next_run_id(log: DataFrame) -> DataFrame:
    """One row with the run id after the largest one used, 1 for an empty log."""
    return log.agg((F.coalesce(F.max("log_run_id"), F.lit(0)) + 1).cast("int").alias("log_run_id"))


def count_message(df: DataFrame, before: str, after: str) -> DataFrame:
    """One row with a message that states how many rows ``df`` has."""
    counted = F.count(F.lit(1)).cast("string")
    return df.agg(F.concat(F.lit(before), counted, F.lit(after)).alias("log_message"))


def text_message(spark: SparkSession, message: str) -> DataFrame:
    """One row with a fixed message."""
    return spark.range(1).select(F.lit(message).alias("log_message"))


def log_event(
    message: DataFrame, log_id: int | Column, run_id: int | Column, as_of: datetime
) -> DataFrame:
    """Log rows in the table's schema out of a one-row message frame."""
    def value(x: int | Column) -> Column:
        return x if isinstance(x, Column) else F.lit(x)

    return message.select(
        value(log_id).cast("long").alias("log_id"),
        value(run_id).cast("int").alias("log_run_id"),
        at(as_of).alias("log_timestamp"),
        "log_message",
    ).to(ACTIVITY_LOG)
