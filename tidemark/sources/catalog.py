"""How large the stored tables are, and whether they fit their budget."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the type code of an ordinary table.
TABLE = "U"
#: Bytes of a value of fixed width; all other types have 8.
WIDTHS = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}


def table_catalog(spark: SparkSession, tables: Mapping[str, DataFrame | None]) -> DataFrame:
    """Name, id, type, row count and KB of each table.

    Frames must come straight from a file source.  Rows are counted per file,
    so that each file's size counts once, and the counts are combined before
    they are shuffled.  A table given as ``None`` has no storage and is listed
    with NULL counts.
    """
    listed = spark.createDataFrame(
        [(name, i + 1, TABLE) for i, name in enumerate(tables)],
        "table_name string, table_id int, table_type string",
    )
    files = None
    for name, df in tables.items():
        if df is not None:
            one = df.select(
                F.lit(name).alias("table_name"),
                F.col("_metadata.file_path").alias("_file"),
                F.col("_metadata.file_size").alias("_bytes"),
            )
            files = one if files is None else files.unionAll(one)
    if files is None:
        return listed.withColumns(
            {"row_count": F.lit(None).cast("long"), "size_kb": F.lit(None).cast("long")}
        )
    per_file = files.groupBy("table_name", "_file", "_bytes").agg(F.count(F.lit(1)).alias("_rows"))
    usage = per_file.groupBy("table_name").agg(
        F.sum("_rows").alias("row_count"), F.ceil(F.sum("_bytes") / 1024).alias("size_kb")
    )
    return listed.join(usage, "table_name", "left")


def content_bytes(field: T.StructField) -> Column:
    """Bytes of a value as such: text in UTF-8, numbers and times by their width; NULL has none."""
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        size = F.octet_length(value)
    elif isinstance(field.dataType, T.ArrayType):
        size = F.size(value) * WIDTHS.get(type(field.dataType.elementType), 8)
    else:
        size = F.lit(WIDTHS.get(type(field.dataType), 8))
    return F.when(value.isNotNull(), size).otherwise(0).cast("long")


def content_catalog(spark: SparkSession, tables: Mapping[str, DataFrame | None]) -> DataFrame:
    """``table_catalog`` with the size of what the rows hold, whatever files they are in.

    It needs no file source, and is the same for equal rows; one sum over each table.
    """
    listed = spark.createDataFrame(
        [(name, i + 1, TABLE) for i, name in enumerate(tables)],
        "table_name string, table_id int, table_type string",
    )
    usage = None
    for name, df in tables.items():
        if df is not None:
            width = sum((content_bytes(f) for f in df.schema.fields), F.lit(0).cast("long"))
            one = df.agg(
                F.lit(name).alias("table_name"),
                F.count(F.lit(1)).alias("row_count"),
                F.ceil(F.coalesce(F.sum(width), F.lit(0)) / 1024).alias("size_kb"),
            )
            usage = one if usage is None else usage.unionAll(one)
    if usage is None:
        return listed.withColumns({"row_count": F.lit(None).cast("long"), "size_kb": F.lit(None).cast("long")})
    return listed.join(usage, "table_name", "left")


def within_budget(catalog: DataFrame, maximum_mb: int) -> DataFrame:
    """One row telling whether the tables together stay under the limit.

    A catalog without any size counts as full, as an unknown total does.
    """
    used = F.sum("size_kb")
    return catalog.agg(
        F.coalesce(F.lit(maximum_mb) * 1024 > used, F.lit(False)).alias("within_budget"),
        used.alias("used_kb"),
    )
