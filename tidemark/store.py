"""The frames a store and a collection run are made of."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

from tidemark import schemas


@dataclass(frozen=True)
class Store:
    """History tables.  Reports need only the frames they read; the rest may stay ``None``."""

    activity_log: DataFrame | None = None
    monitored_databases: DataFrame | None = None
    intervals: DataFrame | None = None
    plan_dbid: DataFrame | None = None
    plans: DataFrame | None = None
    queries: DataFrame | None = None
    excluded_queries: DataFrame | None = None
    query_runtime_stats: DataFrame | None = None
    wait_stats: DataFrame | None = None
    wait_type_filter: DataFrame | None = None

    def with_frames(self, **frames: DataFrame) -> Store:
        """The same store with some tables exchanged."""
        return replace(self, **frames)

    def tables(self) -> dict[str, DataFrame]:
        """The tables present, by name."""
        present = {f.name: getattr(self, f.name) for f in fields(self)}
        return {name: df for name, df in present.items() if df is not None}


@dataclass(frozen=True)
class Inputs:
    """What one collection run reads; ``databases`` translates ids to names."""

    cached_plans: DataFrame
    plan_attributes: DataFrame
    plan_xml: DataFrame
    query_stats: DataFrame
    sql_text: DataFrame
    wait_counters: DataFrame
    databases: DataFrame


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    """An empty frame with the declared schema of a store table."""
    return spark.createDataFrame([], schemas.STORE_TABLES[name])


def empty_store(spark: SparkSession) -> Store:
    """A store without history."""
    return Store(**{name: empty_table(spark, name) for name in schemas.STORE_TABLES})
