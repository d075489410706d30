"""Integer arithmetic as the counters need it: truncating, and silent on empty intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(num: Column, den: Column) -> Column:
    """Whole-number quotient truncated toward zero; NULL when the divisor is zero."""
    return F.call_function("div", num, F.nullif(den, F.lit(0).cast("long")))


def safe_div(num: Column, den: Column) -> Column:
    """``int_div`` with 0 in place of NULL, for averages over intervals without executions."""
    return F.coalesce(int_div(num, den), F.lit(0).cast("long"))


def int_avg(value: Column) -> Column:
    """Whole-number mean of a long column (an aggregate); NULLs do not count."""
    return int_div(F.sum(value), F.count(value))
