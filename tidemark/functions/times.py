"""Time helpers.  Times carry no zone; "now" is always passed in as ``as_of``."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(moment: datetime) -> Column:
    """Zone-less timestamp literal, the same under every session time zone."""
    if moment.tzinfo is not None:
        raise ValueError("as_of must be a naive datetime")
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def time_label(ts: Column) -> Column:
    """Time of day as ``HH:mm:ss``; fractions are cut off, the date is dropped.

    Cutting the text form keeps zone-less values away from the session time
    zone, where a daylight-saving gap would move them.
    """
    return F.substring(ts.cast("timestamp_ntz").cast("string"), 12, 8)
