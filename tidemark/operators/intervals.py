"""The time dimension: opening, closing and looking back over intervals."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import at


def open_close_intervals(runs: DataFrame) -> DataFrame:
    """Intervals made by a list of runs ``(run_id, run_time)`` with dense run ids.

    Run k opens interval k and closes interval k - 1, so an interval ends when
    the next run starts and the newest one is open.  If run k + 1 is missing,
    interval k keeps its NULL end for good.  Joining on the run number rather
    than ordering the whole list keeps the work spread out.
    """
    opened = runs.select(
        F.col("run_id").cast("int").alias("interval_id"), F.col("run_time").alias("interval_start")
    )
    closed = runs.select(
        (F.col("run_id") - 1).cast("int").alias("interval_id"),
        F.col("run_time").alias("interval_end"),
    )
    return opened.join(closed, "interval_id", "left")


def closed_intervals(intervals: DataFrame, as_of: datetime, lookback: timedelta) -> DataFrame:
    """Intervals that ended inside the look-back, the newest one always left out."""
    newest = intervals.agg(F.max("interval_id")).scalar()
    return intervals.filter(
        (F.col("interval_end") >= at(as_of - lookback)) & (F.col("interval_id") < newest)
    )


def closed_within(
    df: DataFrame, intervals: DataFrame, as_of: datetime, lookback: timedelta
) -> DataFrame:
    """Fact rows of the closed intervals in the look-back, with ``interval_end``.

    On facts stored by interval the join prunes folders at run time.
    """
    wanted = closed_intervals(intervals, as_of, lookback)
    return df.join(wanted.select("interval_id", "interval_end"), "interval_id")
