"""Landing a stream of raw snapshots in a store."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.deltas import BLOCK, lifetime, runtime_delta_step, wait_delta_step
from tidemark.schemas import KEYS, SNAPSHOTS, STORE_TABLES
from tidemark.sources.tables import (
    Staging, as_stored, cut_lineage, read_table, replace_intervals, shuffles_freed, staging,
)

#: Rows of a batch that one task sorts at most, if their keys are even.
ROWS_PER_TASK = 500_000

#: A larger batch is stored in slices of intervals, of at least so many rows each and at most so many slices,
#: so that what is shuffled for the store is a fraction of the batch.
ROWS_PER_SLICE = 2_000_000
SLICES = 16

STEPS = {"query_runtime_stats": runtime_delta_step, "wait_stats": wait_delta_step}


def read_snapshots(
    spark: SparkSession, path: str, name: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """A folder of snapshot files as a stream, in the schema of the snapshots of ``name``."""
    reader = spark.readStream.schema(SNAPSHOTS[name])
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def append_batches(root: str, name: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that lands each batch under its own batch id.

    A batch that is repeated after a failure overwrites its own folder, so
    nothing is written twice.
    """

    def land(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/{name}/batch_id={batch_id}")

    return land


def one_per_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key: the last in the order of all columns, so repetitions change nothing."""
    others = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max(F.struct(*others)).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in rows.columns])


def publish_intervals(root: str, name: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that puts the rows of each batch into their intervals.

    A row takes the place of the stored one with its key; other rows of its
    interval stay, so an interval may come in several batches, and repeating
    a batch is harmless.  Of several rows of a batch with one key one is taken,
    the same however they come.
    """
    keys, columns = KEYS[name], STORE_TABLES[name].names

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = cut_lineage(one_per_key(as_stored(batch, name), keys))
        if fresh.isEmpty():
            return
        stored = spark.read.schema(STORE_TABLES[name]).parquet(f"{root}/{name}")
        touched = stored.join(fresh.select("interval_id").distinct(), "interval_id", "left_semi")
        rest = touched.join(fresh.select(*keys), keys, "left_anti").select(*columns)
        replace_intervals(fresh.unionByName(rest), root, name)

    return merge


def publish_differences(root: str, name: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that stores raw snapshots as differences: deltas of a stream as joins.

    The store is the state: the newest row of a key holds lifetime counters and
    is differenced when its successor comes, in whatever batch.  A snapshot
    that comes late is differenced against its successor, and the one before it
    against it, as long as their lifetime counters are still there; otherwise
    it stays as it is, so nothing is lost.  A key and interval that is stored
    already is not stored again, and of several rows of a batch one is taken,
    so repeated batches and rows change nothing.

    Only the intervals of a batch and those right before them are read and
    exchanged; two numbers for each of them reach the driver.  What a batch is
    computed from lies in files until it is stored, and larger batches are dealt
    over more tasks.  Large ones are stored by slices of their intervals, the
    earliest first; each sees the snapshots right after it and a store in which
    nothing after it has changed, so slices change no result.
    """
    keys, columns, step = KEYS[name], STORE_TABLES[name].names, STEPS[name]
    at = F.col("interval_id")
    block = F.call_function("div", at, F.lit(BLOCK))

    def difference(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with shuffles_freed(spark), staging(spark) as stage:
            counts = {r["interval_id"]: r["n"] for r in batch.groupBy(at).agg(F.count(F.lit(1)).alias("n")).collect()}
            if not counts:
                return
            bounds = slice_bounds(counts)
            spread = tasks(spark, sum(counts.values()))
            part = part_of(at, bounds).alias("_part")
            # By key and block, so that rows next to each other in files are alike.
            dealt = batch.select(*SNAPSHOTS[name].names, block.alias("_block"), part).repartition(spread, keys[0], "_block")
            fresh = stage(one_per_key(dealt, ["_part", *keys, "_block"]).drop("_block"), "_part", name="fresh")
            for i, (low, high) in enumerate(zip([None, *bounds], [*bounds, None])):
                within = lambda k: (low is None or k >= low) and (high is None or k < high)
                n = sum(n for k, n in counts.items() if k is None or within(k))
                inside = F.lit(True) if low is None else at >= low
                inside = inside if high is None else inside & (at < high)
                seen = fresh.filter(F.col("_part").between(2 * i - 1, 2 * i + 1))
                own = seen.filter(F.col("_part") <= 2 * i)
                with staging(spark) as stage_slice:
                    store(own.drop("_part"), seen.drop("_part"), inside, tasks(spark, n), stage_slice)
                for done in (2 * i - 1, 2 * i):
                    stage.drop(f"fresh/_part={done}")

    def tasks(spark: SparkSession, n: int) -> int:
        return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS_PER_TASK))

    def store(own: DataFrame, seen: DataFrame, inside: Column, spread: int, stage: Staging) -> None:
        """Store the snapshots ``own`` of a slice; ``seen`` are these and those of the interval after it."""
        spark = own.sparkSession
        before = seen.select(F.explode(F.array(at - 1, at)).alias("interval_id"))
        touched = [r["interval_id"] for r in before.filter(inside).distinct().collect() if r["interval_id"] is not None]
        around = sorted({*touched, *(i + 1 for i in touched)})
        # Listed, not joined, so that other folders of the store are not read.
        near = stage(read_table(spark, root, name).select(*columns).filter(at.isin(around)))
        exchanged = near.filter(at.isin(touched))
        raw = lifetime(near).drop("is_delta")
        earlier = own.join(near.select(*keys), keys, "left_anti").unionByName(lifetime(exchanged).drop("is_delta"))
        later = seen.unionByName(raw.join(seen.select(*keys), keys, "left_anti"))
        dealt = earlier.repartition(spread, *keys)
        rows = stage(step(dealt, later).unionByName(exchanged.filter("is_delta")))
        replace_intervals(rows, root, name, touched)

    return difference


def slice_bounds(counts: Mapping[int | None, int]) -> list[int]:
    """Where slices of about the same number of rows begin, the first left out, given the rows of each interval."""
    total = sum(counts.values())
    slices = max(1, min(SLICES, total // ROWS_PER_SLICE))
    bounds: list[int] = []
    before = counts.get(None, 0)
    for interval_id in sorted(k for k in counts if k is not None):
        if before * slices >= total * (len(bounds) + 1):
            bounds.append(interval_id)
        before += counts[interval_id]
    return bounds


def part_of(at: Column, bounds: list[int]) -> Column:
    """Number of a part: slice ``i`` is made of ``2 * i - 1``, its first interval, and ``2 * i``, the others."""
    part = F.lit(0)
    for bound in bounds:
        part = part + (at >= bound).cast("int") + (at > bound).cast("int")
    return F.coalesce(part, F.lit(0))


def read_landed(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The landed rows as a batch frame, without the batch id."""
    landed = spark.read.schema(SNAPSHOTS[name]).parquet(f"{root}/{name}")
    return landed.select(*SNAPSHOTS[name].names)
