"""From cumulative snapshots to what happened inside each interval.

A row (key, k) is differenced against (key, k + 1).  A row without that
successor keeps its cumulative counters; ``is_delta`` tells the two apart.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.arithmetic import safe_div
from tidemark.schemas import METRICS, WAIT_COUNTERS

RUNTIME_COUNTERS = ("execution_count", *[f"total_{m}" for m in METRICS])
RESET_MODES = ("keep", "zero", "null")

#: Intervals per window group.  It bounds what one task sorts for one key.
BLOCK = 1024


def with_successor(
    df: DataFrame, key: str, counters: Sequence[str], block: int = BLOCK, partitions: int | None = None
) -> DataFrame:
    """Add ``next_<counter>`` from the row of the following interval, and ``is_delta``.

    The history of a key is cut into blocks of ``block`` intervals, so a key
    with a very long history is spread over many tasks.  The first row of a
    block also travels with the block before it, to be the successor of that
    block's last row, and is dropped there afterwards.  The one shuffle is by
    key and block, also where the rows come dealt by key alone, so no task
    sorts the whole history of a key.  ``partitions`` is for histories that are
    too large for the session's number of shuffle partitions.
    """
    home = F.call_function("div", F.col("interval_id"), F.lit(block))
    here = F.when(
        F.col("interval_id") % block == 0, F.array(home, home - 1)
    ).otherwise(F.array(home))
    dealt = [key, "_block"] if partitions is None else [partitions, key, "_block"]
    spread = df.withColumn("_block", F.explode(here)).repartition(*dealt)
    w = Window.partitionBy(key, "_block").orderBy("interval_id")
    adjacent = F.lead("interval_id").over(w) == F.col("interval_id") + 1
    out = spread.select(
        "*",
        F.coalesce(adjacent, F.lit(False)).alias("is_delta"),
        *[F.lead(c).over(w).alias(f"next_{c}") for c in counters],
    )
    return out.filter(F.col("_block") == home).drop("_block")


def _with_next_snapshot(
    earlier: DataFrame, later: DataFrame, key: str, counters: Sequence[str]
) -> DataFrame:
    """The same columns from two adjacent snapshots, joined on the key."""
    nxt = later.select(
        key,
        (F.col("interval_id") - 1).cast("int").alias("interval_id"),
        F.lit(True).alias("is_delta"),
        *[F.col(c).alias(f"next_{c}") for c in counters],
    )
    joined = earlier.join(nxt, [key, "interval_id"], "left")
    return joined.withColumn("is_delta", F.coalesce("is_delta", F.lit(False)))


def _difference(counter: str, on_reset: str = "keep") -> Column:
    step = F.col(f"next_{counter}") - F.col(counter)
    if on_reset == "zero":
        step = F.greatest(step, F.lit(0).cast("long"))
    elif on_reset == "null":
        step = F.when(step >= 0, step)
    return F.when(F.col("is_delta"), step).otherwise(F.col(counter))


def _runtime_columns(paired: DataFrame, on_reset: str) -> DataFrame:
    if on_reset not in RESET_MODES:
        raise ValueError(f"on_reset must be one of {RESET_MODES}")
    changed = {c: _difference(c, on_reset) for c in RUNTIME_COUNTERS}
    runs = changed["execution_count"]
    for m in METRICS:
        average = safe_div(changed[f"total_{m}"], runs)
        changed[f"avg_{m}"] = F.when(F.col("is_delta"), average).otherwise(F.col(f"avg_{m}"))
    kept = [c for c in paired.columns if not c.startswith("next_")]
    return paired.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in kept])


def runtime_delta(
    snapshots: DataFrame,
    strict: bool = False,
    on_reset: str = "keep",
    block: int = BLOCK,
    partitions: int | None = None,
) -> DataFrame:
    """Difference a whole history of runtime snapshots.

    The count and the six totals are differenced and give the averages; last,
    min, max and the two times stay as they are.  Counters can shrink when a
    plan is evicted: ``on_reset`` keeps the negative step, or makes it 0 or
    NULL.  ``strict`` drops the rows that could not be differenced;
    ``partitions`` is that of ``with_successor``.
    """
    paired = with_successor(snapshots, "query_id", RUNTIME_COUNTERS, block, partitions)
    out = _runtime_columns(paired, on_reset)
    return out.filter("is_delta") if strict else out


def runtime_delta_step(earlier: DataFrame, later: DataFrame, on_reset: str = "keep") -> DataFrame:
    """Difference one snapshot against the one after it; ``runtime_delta`` for a single run.

    Reads just the two newest intervals, so its cost does not grow with history.
    """
    return _runtime_columns(
        _with_next_snapshot(earlier, later, "query_id", RUNTIME_COUNTERS), on_reset
    )


def lifetime(stored: DataFrame) -> DataFrame:
    """Stored rows that hold lifetime counters; rows without a state count as such."""
    return stored.filter(~F.coalesce(F.col("is_delta"), F.lit(False)))


def first_pending(stored: DataFrame, key: str, newest: int) -> int:
    """The first interval that still waits for its differences; ``newest`` if no run has failed.

    A run that stopped before it stored differences leaves a key's lifetime counters in two
    intervals in a row.  Two intervals are looked at, then the two before if they hold such a
    pair, and so on, so this reads as far back as runs have failed and no farther.
    """
    while newest > 1:
        both = lifetime(stored.filter(F.col("interval_id").isin(newest - 1, newest)))
        if both.groupBy(key).agg(F.count_distinct("interval_id").alias("n")).filter("n > 1").isEmpty():
            break
        newest -= 1
    return newest


def catch_up(
    stored: DataFrame, later: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame]
) -> DataFrame:
    """Difference all stored lifetime counters that have a successor, stored or in ``later``.

    ``step`` is ``runtime_delta_step`` or ``wait_delta_step``.  Rows that hold differences stay as
    they are and are nobody's successor, as their lifetime counters are gone.
    """
    raw = lifetime(stored).drop("is_delta")
    fresh = step(raw, raw.unionByName(later.select(*raw.columns)))
    return fresh.unionByName(stored.filter("is_delta"))


def _wait_columns(paired: DataFrame) -> DataFrame:
    changed = {c: _difference(c) for c in WAIT_COUNTERS}
    kept = [c for c in paired.columns if not c.startswith("next_")]
    return paired.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in kept])


def _drop_idle(waits: DataFrame, closed: Column) -> DataFrame:
    return waits.filter(~(closed & (F.col("waiting_tasks_count") == 0)))


def wait_delta(snapshots: DataFrame, strict: bool = False, block: int = BLOCK) -> DataFrame:
    """Difference a whole history of wait snapshots and drop intervals without new waits.

    All four counters are differenced, the maximum too.  Negative steps stay.
    Snapshots only hold positive counts, so a zero can only be a difference.
    """
    out = _wait_columns(with_successor(snapshots, "wait_type", WAIT_COUNTERS, block))
    out = _drop_idle(out, F.col("is_delta"))
    return out.filter("is_delta") if strict else out


def wait_delta_step(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """Difference one wait snapshot against the one after it, idle rows dropped."""
    paired = _with_next_snapshot(earlier, later, "wait_type", WAIT_COUNTERS)
    return _drop_idle(_wait_columns(paired), F.lit(True))
