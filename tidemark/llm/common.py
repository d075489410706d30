"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.tables import cut_lineage, shared_folder

#: Separators between words: space and the five control characters from tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"


def cut(df: DataFrame) -> DataFrame:
    """Compute a frame once and for all into the folder that ``spark.checkpoint.dir`` names.

    Only in local sessions without that setting a temporary folder stands in.
    """
    return cut_lineage(df)


def shared_table(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write a frame as Parquet under a name in the shared folder, and read it back."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_shared(spark: SparkSession, name: str) -> None:
    """Remove a table that ``shared_table`` wrote, if there is one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Words between blanks, as an array; NULL text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def word_count(text: Column) -> Column:
    """Number of words between blanks, as a long."""
    return F.size(words_of(text)).cast("long")


def arrow_rows(
    df: DataFrame, each: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]], schema: str
) -> DataFrame:
    """Map batches of rows: ``each`` takes and gives dictionaries of column lists.

    Strings arrive as UTF-8 bytes, so nothing is decoded that need not be.
    """
    types = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(types)

        def lists() -> Iterator[dict[str, list]]:
            for batch in batches:
                yield {
                    name: (
                        column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
                        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type)
                        else column
                    ).to_pylist()
                    for name, column in zip(batch.schema.names, batch.columns, strict=True)
                }

        for out in each(lists()):
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow
            )

    return df.mapInArrow(run, types)


def bucket_number(rows: int) -> int:
    """Buckets so that both their number and their size grow with the square root of the rows."""
    return max(1, 2 * int(rows**0.5))


def running_total(
    df: DataFrame, group: str, digest: str, order: list[str], value: str, rows: int, name: str
) -> DataFrame:
    """Sum of ``value`` over the rows before each one in its group, as column ``name``.

    Rows of a group come in the order of ``digest``, a column of hexadecimal text, and then of
    ``order``.  A group is summed by the first digits of the digest, as many as suit the number of
    rows, and only these sums are ordered as a whole, so that no task holds a whole group, however
    large.  ``group`` must not be NULL.
    """
    digits = 1
    while 16**digits < bucket_number(rows):
        digits += 1
    df = df.withColumn("__bucket", F.substring(digest, 1, digits))
    before = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(group, "__bucket")
        .agg(F.sum(value).alias("__sum"))
        .select(group, "__bucket", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    )
    inside = Window.partitionBy(group, "__bucket").orderBy(digest, *order)
    earlier = F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    return (
        df.withColumn("__earlier", F.coalesce(earlier, F.lit(0)))
        .join(offsets, [group, "__bucket"])
        .withColumn(name, F.col("__offset") + F.col("__earlier"))
        .drop("__bucket", "__offset", "__earlier")
    )


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number the rows 0, 1, 2 ... in the given order.

    Ranges are sorted in tasks of their own; only their counts, one per range, are summed up.
    """
    sorted_rows = cut(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    )
    part, inside = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    counts = sorted_rows.groupBy(part.alias("__part")).count()
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    return (
        sorted_rows.withColumn("__part", part)
        .join(starts, "__part")
        .withColumn(name, F.col("__start") + inside)
        .drop("__at", "__part", "__start")
    )


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of links (``a``, ``b``): every linked id with the smallest id it reaches.

    Each round links the neighbours of an id with the smallest among them (first the larger ones,
    then the smaller ones), until every id is linked with the smallest of its component alone.
    Rounds are cut, so a lost executor costs one round; nothing but a count reaches the driver.
    """
    links = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    before = None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a > b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b")
        links = cut(small.unionByName(lower.select("a", F.col("m").alias("b"))).distinct())
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    roots = links.select(F.col("b").alias("id")).distinct()
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        roots.select("id", F.col("id").alias("component"))
    )


def top_per_group(
    df: DataFrame, group: list[str], order: list[Column], spread: str, k: int, name: str, salts: int = 64
) -> DataFrame:
    """The first ``k`` rows of each group in the given order, numbered from 1 in column ``name``.

    Groups are first cut down in ``salts`` parts by the hash of column ``spread``, so that no task
    sees more than ``salts * k`` rows of a group at the end, however large it is.
    """
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    part = Window.partitionBy(*group, "__salt").orderBy(*order)
    first = salted.withColumn("__rank", F.row_number().over(part)).filter(F.col("__rank") <= k)
    whole = Window.partitionBy(*group).orderBy(*order)
    return first.drop("__salt", "__rank").withColumn(name, F.row_number().over(whole)).filter(F.col(name) <= k)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames."""
    return reduce(DataFrame.unionByName, frames)
