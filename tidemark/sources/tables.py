"""Reading and writing a store as Parquet folders."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from uuid import uuid4

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.store import Store, empty_table

CHECKPOINT_DIR = "spark.checkpoint.dir"

#: Whether shuffle files go when their query ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Tables of a store that are written at the same time.
WRITERS = 4

#: Facts are dealt into so many parts before they are written, by groups of so many intervals that follow
#: each other.  Parts too small for a task are merged and those too large are split, each piece making a file
#: for every interval in it.
PARTS = 512
TOGETHER = 4


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset,
    as in local tests, a temporary folder stands in.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        folder = context.getCheckpointDir()
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute a frame once and for all into the shared folder."""
    context = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


class Staging:
    """Computes frames once, into files of a folder of its own under the shared one."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/staged-{uuid4().hex}"

    def __call__(self, df: DataFrame, *by: str, name: str | None = None) -> DataFrame:
        """The frame, read from files; those of each value of the columns ``by`` lie in a folder."""
        path = f"{self.folder}/{name or uuid4().hex}"
        df.write.partitionBy(*by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Remove the files of a frame, or of a folder in it that is not read any more; all of them without a name."""
        path, fs = _path(self.spark, f"{self.folder}/{name}" if name else self.folder)
        fs.delete(path, True)


@contextmanager
def staging(spark: SparkSession) -> Iterator[Staging]:
    """A function that computes a frame once, into files of the shared folder that go when the block ends.

    Columns in files take a fraction of the room of checkpointed rows, which stay until the session ends.
    """
    stage = Staging(spark)
    try:
        yield stage
    finally:
        stage.drop()


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What queries that begin inside the block shuffle goes when they end.

    Otherwise it stays until the driver collects garbage, and queries that follow each other add up on disk.
    A frame that is run again makes its shuffles anew.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table with its declared schema.

    Intervals are written as events, an opening and later a closing, and put
    together on reading; the other tables are read as they are.
    """
    return _as_read(_files(spark, root, name), root, name)


def _files(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(schemas.STORE_TABLES[name]).parquet(f"{root}/{name}")


def _as_read(df: DataFrame, root: str, name: str) -> DataFrame:
    if name == "intervals":
        df = df.groupBy("interval_id").agg(
            F.min("interval_start").alias("interval_start"),
            F.max("interval_end").alias("interval_end"),
        )
    return _without_expired(df, root, name) if name in schemas.EXPIRED else df


def _without_expired(facts: DataFrame, root: str, name: str) -> DataFrame:
    """Facts without the rows that ``expire`` has listed since the table was last compacted.

    A limit on all keys compares intervals alone and so prunes folders; limits
    on single keys are an anti join.
    """
    spark = facts.sparkSession
    if not _exists(spark, f"{root}/{schemas.EXPIRED[name]}"):
        return facts
    key = schemas.KEYS[name][0]
    listed = spark.read.schema(schemas.expired(name)).parquet(f"{root}/{schemas.EXPIRED[name]}")
    limit = listed.filter(F.col(key).isNull()).agg(F.max("up_to").alias("up_to")).scalar()
    facts = facts.filter(F.coalesce(F.col("interval_id") > limit, F.lit(True)))
    single = listed.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max("up_to").alias("_up_to"))
    hidden = (F.col(key) == F.col("_key")) & (F.col("interval_id") <= F.col("_up_to"))
    return facts.join(single, hidden, "left_anti")


def expire(limits: DataFrame, root: str, name: str) -> None:
    """Hide facts from readers without touching them: rows of a key up to an interval.

    ``limits`` has the key (``query_id`` or ``wait_type``; NULL means all) and
    ``up_to``.  Ids that are given again later start beyond it.
    """
    fields = schemas.expired(name).fields
    rows = limits.select(*[F.col(f.name).cast(f.dataType) for f in fields])
    rows.write.mode("append").parquet(f"{root}/{schemas.EXPIRED[name]}")


def compact(spark: SparkSession, root: str, name: str) -> None:
    """Write a fact table anew without its hidden rows, and forget what was hidden."""
    folder = f"{root}/{schemas.EXPIRED[name]}"
    if _exists(spark, folder):
        swap_table(read_table(spark, root, name), root, name)
        path, fs = _path(spark, folder)
        fs.delete(path, True)


def _exists(spark: SparkSession, folder: str) -> bool:
    path, fs = _path(spark, folder)
    return fs.exists(path)


def read_store(spark: SparkSession, root: str, facts: Mapping[str, DataFrame] | None = None) -> Store:
    """All tables of a store.

    ``facts`` are the scans of ``fact_files``, for a caller that reads a store again and knows that
    no file of a fact has changed: their many folders are then not listed another time.
    """
    files = {name: _files(spark, root, name) for name in schemas.STORE_TABLES if name not in (facts or {})}
    return Store(**{name: _as_read(df, root, name) for name, df in {**files, **(facts or {})}.items()})


def fact_files(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The facts as plain file scans, hidden rows included."""
    return {name: _files(spark, root, name) for name in schemas.PARTITIONED_BY}


def stored_files(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables as plain file scans, for ``tidemark.sources.catalog``."""
    return {name: _files(spark, root, name) for name in schemas.STORE_TABLES}


def as_stored(df: DataFrame, name: str) -> DataFrame:
    """The columns of a store table.  Facts without ``is_delta`` are snapshots as they were taken."""
    if name in schemas.SNAPSHOTS and schemas.STATE not in df.columns:
        df = df.withColumn(schemas.STATE, F.lit(False))
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schemas.STORE_TABLES[name].fields])


def _writer(df: DataFrame, name: str):
    """Writer in the table's layout.

    Rows of a few intervals are brought together, and large ones are split
    again into evenly sized files.  No other intervals are split with them, so
    files grow with the rows before they multiply.
    """
    df = as_stored(df, name)
    partition = schemas.PARTITIONED_BY.get(name)
    if partition is None:
        return df.write
    group = F.call_function("div", F.col(partition), F.lit(TOGETHER))
    dealt = df.withColumn("_group", group).hint("rebalance", PARTS, F.col("_group")).drop("_group")
    return dealt.write.partitionBy(partition)


def write_store(store: Store, root: str) -> None:
    """Write every table to a new location.

    This is how retention and purge are published: write, then point readers
    to the new root.  A location that is being read is never overwritten.
    Small tables are written beside the large ones, a few at a time.
    """
    def write(name: str, df: DataFrame) -> None:
        _writer(df, name).mode("errorifexists").parquet(f"{root}/{name}")

    with ThreadPoolExecutor(WRITERS) as pool:
        jobs = [
            pool.submit(inheritable_thread_target(df.sparkSession)(write), name, df)
            for name, df in store.tables().items()
        ]
    for job in jobs:
        job.result()


def create_store(spark: SparkSession, root: str, **initial: DataFrame) -> Store:
    """Write an empty store, with the given tables filled in, and read it back."""
    frames = {name: empty_table(spark, name) for name in schemas.STORE_TABLES}
    write_store(Store(**{**frames, **initial}), root)
    return read_store(spark, root)


def purge_store(spark: SparkSession, root: str) -> None:
    """Empty every history table in place; watched databases and wait filter stay."""
    for name in schemas.STORE_TABLES:
        if name not in schemas.KEPT_ON_PURGE:
            writer = _writer(empty_table(spark, name), name).mode("overwrite")
            writer.option("partitionOverwriteMode", "static").parquet(f"{root}/{name}")
    for folder in schemas.EXPIRED.values():
        path, fs = _path(spark, f"{root}/{folder}")
        fs.delete(path, True)


def wait_type_filter(spark: SparkSession, names: Sequence[str], is_default: bool = True) -> DataFrame:
    """A filter table out of a list of wait types, each listed once."""
    return spark.createDataFrame(
        [(name, is_default) for name in dict.fromkeys(names)], schemas.WAIT_TYPE_FILTER
    )


def append_rows(df: DataFrame, root: str, name: str) -> None:
    """Add rows to a table."""
    _writer(df, name).mode("append").parquet(f"{root}/{name}")


def replace_intervals(df: DataFrame, root: str, name: str, interval_ids: Sequence[int] = ()) -> None:
    """Exchange the intervals that occur in ``df``; repeating it is harmless.

    Intervals in ``interval_ids`` of which ``df`` has no row are emptied; all
    others stay.  ``df`` may read the table itself: files are exchanged when
    the new ones are complete.
    """
    if name not in schemas.PARTITIONED_BY:
        raise ValueError(f"{name} is not stored by interval")
    emptied: set[int] = set()
    if interval_ids:
        listed = df.filter(F.col("interval_id").isin(list(interval_ids)))
        present = {r[0] for r in listed.select("interval_id").distinct().collect()}
        emptied = set(interval_ids) - present
    (
        _writer(df, name)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(f"{root}/{name}")
    )
    drop_intervals(df.sparkSession, root, name, emptied)


def drop_intervals(spark: SparkSession, root: str, name: str, interval_ids: Iterable[int]) -> None:
    """Remove whole intervals without reading them."""
    for interval_id in interval_ids:
        path, fs = _path(spark, f"{root}/{name}/interval_id={interval_id}")
        fs.delete(path, True)


def swap_table(df: DataFrame, root: str, name: str) -> None:
    """Exchange a whole table, which ``df`` may read, for new files written next to it."""
    spark = df.sparkSession
    _writer(df, name).mode("overwrite").parquet(f"{root}/{name}__next")
    current, fs = _path(spark, f"{root}/{name}")
    following, _ = _path(spark, f"{root}/{name}__next")
    previous, _ = _path(spark, f"{root}/{name}__previous")
    fs.delete(previous, True)
    if not (fs.rename(current, previous) and fs.rename(following, current)):
        raise OSError(f"could not exchange {root}/{name}")
    fs.delete(previous, True)


def _path(spark: SparkSession, text: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(text)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def publish_run(changes: Mapping[str, DataFrame], root: str, interval_ids: Sequence[int] = ()) -> None:
    """Write what one collection run produced (see ``tidemark.plans.gather``).

    The order makes a failed run safe to repeat.  Plans and queries precede the
    ledger of seen handles, so they are found again.  Until the new interval is
    opened, a repeated run takes the same id and overwrites its snapshot.  The
    differences replace earlier snapshots last of all and from the earliest on:
    where a run fails, it leaves snapshots next to each other, which the next
    run finds and differences (``tidemark.operators.deltas.catch_up``).
    """
    newest = max(interval_ids, default=None)
    facts = [name for name in schemas.PARTITIONED_BY if name in changes]

    def append(*names: str) -> None:
        for name in names:
            if name in changes:
                append_rows(changes[name], root, name)

    append("plans", "queries", "plan_dbid")
    for name in facts:
        snapshot = changes[name].filter(F.col("interval_id") == newest)
        replace_intervals(snapshot, root, name, [newest])
    append("intervals")
    for interval_id in sorted(i for i in interval_ids if i != newest):
        for name in facts:
            differences = changes[name].filter(F.col("interval_id") == interval_id)
            replace_intervals(differences, root, name, [interval_id])
    append("activity_log")
