"""Server version strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LARGEST = 2**63 - 1


def version_parts(version: Column) -> Column:
    """``major.minor.build[...]`` as a comparable struct of longs.

    A part counts by its leading digits, however many fit a long (more stand for
    the largest one); parts that are absent or have none are 0.
    """

    def part(i: int) -> Column:
        digits = F.regexp_extract(F.split_part(version, F.lit("."), F.lit(i)), r"^\d+", 0)
        return F.when(digits == "", F.lit(0)).otherwise(F.coalesce(digits.try_cast("bigint"), F.lit(LARGEST)))

    return F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("build"))


def at_least(parts: Column, since: tuple[int, int, int]) -> Column:
    """True when a ``version_parts`` struct is not older than ``since``."""
    bound = F.struct(
        *[F.lit(n).cast("bigint").alias(name) for n, name in zip(since, ("major", "minor", "build"), strict=True)]
    )
    return parts >= bound


def parse_version(version: str) -> tuple[int, int, int]:
    """The same split for a version known on the driver."""
    digits = [re.match(r"\d*", p)[0] for p in version.split(".")[:3]]
    parts = [min(int(d or 0), LARGEST) for d in digits]
    return tuple(parts + [0] * (3 - len(parts)))
