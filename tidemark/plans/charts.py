"""What the charts compute on top of a report: sums, matrices, shares, moving averages.

Input is always a report frame: a few rows per time label, never raw facts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIOD = 2


def chart_sums(frame: DataFrame, category: str, values: Sequence[str], series: str | None = None) -> DataFrame:
    """Sums per category, and per series if the chart has one."""
    keys = [category] if series is None else [category, series]
    return frame.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values]).orderBy(*keys)


def chart_matrix(
    frame: DataFrame, category: str, series: str, value: str, series_values: Sequence[str]
) -> DataFrame:
    """Sums as a table: categories down, the given series across."""
    return (
        frame.groupBy(category)
        .pivot(series, list(series_values))
        .agg(F.sum(value))
        .orderBy(category)
    )


def plan_counts(frame: DataFrame) -> DataFrame:
    """Plans per query and database of ``multiple_plans``."""
    return frame.groupBy("query_id", "query_database").agg(F.count("plan_id").alias("plan_count"))


def percent_of_total(frame: DataFrame, value: str, out: str = "share") -> DataFrame:
    """Each row's share of the sum over a top-n frame, between 0 and 1."""
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.nullif(F.sum(value).over(whole).cast("double"), F.lit(0.0))
    return frame.withColumn(out, F.col(value).cast("double") / total)


def moving_average(
    frame: DataFrame,
    order: str,
    value: str,
    period: int = PERIOD,
    start_from_first: bool = True,
    out: str = "moving_avg",
) -> DataFrame:
    """Mean over the last ``period`` points in time order.

    The first points, with fewer predecessors, average what there is, or are
    NULL with ``start_from_first=False``.  The frame has one row per time
    label, of which a day has at most 86,400, so one task orders it.
    """
    w = Window.orderBy(order).rowsBetween(-(period - 1), 0)
    mean: Column = F.avg(F.col(value).cast("double")).over(w)
    if not start_from_first:
        mean = F.when(F.count(F.lit(1)).over(w) == period, mean)
    return frame.withColumn(out, mean)


def exclusion_caption(counts: DataFrame) -> DataFrame:
    """Caption text with the number of excluded queries."""
    return counts.select(
        F.format_string("Excluded queries: %d", F.sum("excluded_query_count")).alias("caption")
    )


def filter_caption(counts: DataFrame) -> DataFrame:
    """Caption text with the number of filtered wait types."""
    return counts.select(
        F.format_string("Filtered wait types: %d", F.sum("wait_type_filter_count")).alias("caption")
    )
