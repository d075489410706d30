"""Interval totals over a live feed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_totals(
    events: DataFrame,
    time: str,
    measures: dict[str, str],
    keys: Sequence[str] = (),
    length: str = "1 hour",
    delay: str = "1 hour",
) -> DataFrame:
    """Row count and sums per tumbling interval, emitted once the interval is final.

    ``measures`` maps result names to the columns to sum.  Rows later than the
    ``delay`` behind the newest one are dropped.  Times carry no zone, and the
    watermark passes them through the session's, so that must not shift its
    clock: the session has to run in UTC.
    """
    zone = events.sparkSession.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"interval totals need a session in UTC, not {zone}")
    return (
        events.withColumn(time, F.col(time).cast("timestamp"))
        .withWatermark(time, delay)
        .groupBy(F.window(time, length).alias("_window"), *keys)
        .agg(F.count(F.lit(1)).alias("events"), *[F.sum(c).alias(n) for n, c in measures.items()])
        .select(
            F.col("_window.start").cast("timestamp_ntz").alias("interval_start"),
            F.col("_window.end").cast("timestamp_ntz").alias("interval_end"),
            *keys,
            "events",
            *measures,
        )
    )
