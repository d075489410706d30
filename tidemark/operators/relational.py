"""Semi and anti joins, top-n and numbering, used by every other module.

None of the joins carries a broadcast hint: Spark broadcasts a side when its
size is below ``spark.sql.autoBroadcastJoinThreshold`` (checked at run time by
adaptive execution) and shuffles both sides otherwise, splitting hot keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _columns(on: str | Sequence[str]) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def keep_listed(df: DataFrame, listed: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``listed`` (IN / EXISTS)."""
    keys = _columns(on)
    return df.join(listed.select(*keys), keys, "left_semi")


def drop_listed(df: DataFrame, listed: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key does not occur in ``listed``.

    Rows with a NULL key go, as they do under NOT IN; NULLs in the list are
    ignored.  A plain anti join would keep the former.
    """
    keys = _columns(on)
    for key in keys:
        df = df.filter(F.col(key).isNotNull())
        listed = listed.filter(F.col(key).isNotNull())
    return df.join(listed.select(*keys), keys, "left_anti")


def top_n(df: DataFrame, order: Sequence[Column], n: int | None) -> DataFrame:
    """First ``n`` rows under a total order; all of them when ``n`` is None."""
    ordered = df.orderBy(*order)
    return ordered if n is None else ordered.limit(n)


def top_k_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "r"
) -> DataFrame:
    """First ``k`` rows of every group, numbered from 1.

    Spark limits each group to ``k`` rows before the shuffle, so a hot group
    reaches its task already cut down.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def assign_ids(
    rows: DataFrame,
    id_col: str,
    key_cols: Sequence[str],
    max_id: int | Column = 0,
    digits: int = 3,
) -> DataFrame:
    """Number new rows without gaps, starting at ``max_id + 1``.

    The natural key is hashed into ``16 ** digits`` even buckets; rows are
    numbered inside their bucket and shifted by the size of the buckets before.
    No task sees more than one bucket, however large the batch, and the one
    frame that is broadcast has ``16 ** digits`` rows.  The numbers follow
    (hash prefix, key), so the same rows always get the same ids.
    """
    if not 1 <= digits <= 4:
        raise ValueError("digits must lie in 1..4")
    text = F.concat_ws("\x1f", *[F.col(c).cast("string") for c in key_cols])
    bucketed = rows.withColumn("_bucket", F.substring(F.md5(text), 1, digits))
    sizes = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("_bucket").orderBy(*key_cols)
    start = max_id if isinstance(max_id, Column) else F.lit(max_id)
    number = start + F.col("_offset") + F.row_number().over(inside)
    return (
        bucketed.join(F.broadcast(offsets), "_bucket")
        .withColumn(id_col, number)
        .drop("_bucket", "_offset")
    )


def next_id(df: DataFrame, col: str) -> Column:
    """Largest id so far as a scalar expression; 0 for an empty table."""
    return df.agg(F.coalesce(F.max(col), F.lit(0)).alias(col)).scalar()
