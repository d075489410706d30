"""Shards of equal size by longest-processing-time scheduling of groups that must stay together."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bucket_number, cut

#: Groups above the total over (shards * LARGE) are placed one by one: there are at most shards * LARGE.
LARGE = 512
#: All smaller groups share this many units, by a hash of their text.
UNITS = 4096


def longest_first(sizes: list[tuple[int, int]], n_shards: int) -> dict[int, int]:
    """Shard of each (key, size): in falling order of size, each to the least loaded shard."""
    loads = [(0, shard) for shard in range(n_shards)]
    placed = {}
    for key, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(loads)
        placed[key] = shard
        heapq.heappush(loads, (load + size, shard))
    return placed


def assign_shards(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """The rows of ``docs``, all columns, with ``shard`` (0 to n_shards - 1) and ``slot``.

    A document's size is the UTF-8 bytes of its text plus 1; documents of equal text are a group
    and share a shard, and so do all without text (NULL counts as empty).  Large groups and units
    of small groups go by size to the least loaded shard.  The number of both is bounded by
    constants, so the heap on the driver is too, whatever the input.  A group larger than an even
    share cannot be split: its shard is that much larger, and the others are evened out.

    slot numbers the rows of a shard from 0 without gaps, in the order of a hash bucket and then of
    doc_id and text; rows are counted by shard and bucket, so that no task holds a whole shard.
    Tables without rows give none; columns named shard or slot are replaced.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    group = F.xxhash64(text)
    sizes = cut(docs.select(group.alias("g"), (F.octet_length(text) + 1).cast("long").alias("s")).groupBy("g").agg(F.sum("s").alias("s"), F.count("*").alias("n")))
    total, rows = sizes.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    unit = F.pmod("g", F.lit(UNITS))
    is_large = F.col("s") * (n_shards * LARGE) > total
    large = [(r.g, r.s) for r in sizes.filter(is_large).select("g", "s").collect()]
    units = [(r.u, r.s) for r in sizes.filter(~is_large).groupBy(unit.alias("u")).agg(F.sum("s").alias("s")).collect()]
    placed = longest_first([((0, g), s) for g, s in large] + [((1, u), s) for u, s in units], n_shards)
    alone = spark.createDataFrame([(g, placed[0, g]) for g, _ in large], "__g long, __alone int")
    shared = spark.createDataFrame([(u, placed[1, u]) for u, _ in units], "__u long, __shared int")
    buckets = bucket_number(rows)
    # both tables are bounded by constants (see LARGE and UNITS), so they may be broadcast
    found = (
        docs.drop("shard", "slot")
        .withColumn("__g", group)
        .join(F.broadcast(alone), "__g", "left")
        .withColumn("__u", F.pmod("__g", F.lit(UNITS)))
        .join(F.broadcast(shared), "__u", "left")
        .withColumn("shard", F.coalesce("__alone", "__shared"))
        .withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "__g"), F.lit(buckets)))
    )
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        found.groupBy("shard", "__bucket")
        .agg(F.count("*").alias("__n"))
        .select("shard", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    )
    inside = Window.partitionBy("shard", "__bucket").orderBy("doc_id", "__g")
    return (
        found.withColumn("__row", F.row_number().over(inside) - 1)
        .join(starts, ["shard", "__bucket"])
        .withColumn("slot", (F.col("__start") + F.col("__row")).cast("long"))
        .select(*[c for c in docs.columns if c not in ("shard", "slot")], "shard", "slot")
    )
