"""One stable schema over statement statistics from servers of any version."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.versions import at_least, parse_version, version_parts
from tidemark.schemas import QUERY_STATS, VERSIONED_COLUMNS


def _default(field: T.StructField) -> Column:
    """Stand-in for a column a server does not report: 0 for counters, NULL otherwise."""
    counter = isinstance(field.dataType, T.LongType) and field.name != "statement_context_id"
    return F.lit(0 if counter else None).cast(field.dataType)


def align_query_stats(
    df: DataFrame, version: str | Column, schema: T.StructType = QUERY_STATS
) -> DataFrame:
    """Select the full schema from ``df``, filling what its server version lacks.

    ``version`` is a literal for a frame from one server, or a column for a
    frame that mixes servers; then each row is filled by its own version.
    """
    out = []
    for field in schema.fields:
        since = VERSIONED_COLUMNS.get(field.name)
        value = F.col(field.name).cast(field.dataType) if field.name in df.columns else None
        if since is None:
            if value is None:
                raise ValueError(f"column {field.name} is reported by every version but missing")
        elif isinstance(version, Column):
            known = at_least(version_parts(version), since)
            default = _default(field)
            value = default if value is None else F.when(known, value).otherwise(default)
        elif parse_version(version) < since:
            value = _default(field)
        elif value is None:
            raise ValueError(f"column {field.name} should be present in version {version}")
        out.append(value.alias(field.name))
    return df.select(*out)


def union_versions(parts: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Statement statistics of several servers in the common schema."""
    frames = [align_query_stats(df, version) for df, version in parts]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
