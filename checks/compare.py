"""Compare every registered query with its SQL: ``python -m checks.compare <dir> [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.oracle import ORACLE
from checks.queries import REGISTRY, TABLES


def canonical(value) -> str:
    return repr(round(value, 6)) if isinstance(value, float) else str(value)


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def difference(spark: SparkSession, con, sf_dir: str, name: str) -> tuple[str | None, int, float, float]:
    """What differs between a query and its SQL, with row count and both times."""
    started = time.time()
    df = REGISTRY[name](spark, sf_dir)
    ours = [tuple(r) for r in df.collect()]
    spark_sec = time.time() - started
    if name not in ORACLE:
        return None, len(ours), spark_sec, 0.0
    started = time.time()
    result = con.execute(ORACLE[name])
    theirs_columns = [d[0] for d in result.description]
    theirs = result.fetchall()
    sql_sec = time.time() - started
    if sorted(df.columns) != sorted(theirs_columns):
        return f"columns {sorted(df.columns)} != {sorted(theirs_columns)}", len(ours), spark_sec, sql_sec
    a, b = rows_of(df.columns, ours), rows_of(theirs_columns, theirs)
    if a == b:
        return None, len(ours), spark_sec, sql_sec
    only_a = [r for r in a if r not in set(b)][:3]
    only_b = [r for r in b if r not in set(a)][:3]
    return f"rows {len(a)} vs {len(b)}; only ours {only_a}; only SQL {only_b}", len(ours), spark_sec, sql_sec


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv: list[str]) -> int:
    sf_dir, names = argv[0], argv[1:] or list(REGISTRY)
    spark, con = session(), connect(sf_dir)
    bad = 0
    for name in names:
        try:
            diff, n, spark_sec, sql_sec = difference(spark, con, sf_dir, name)
        except Exception as e:  # noqa: BLE001 - report and go on
            diff, n, spark_sec, sql_sec = f"{type(e).__name__}: {str(e)[:600]}", -1, 0.0, 0.0
        state = "ROWS" if name not in ORACLE and diff is None else ("ok" if diff is None else "DIFF")
        bad += diff is not None
        print(f"{state:5}{name:28}{n:9} rows  spark {spark_sec:6.2f}s  sql {sql_sec:6.2f}s  {diff or ''}", flush=True)
    print(f"{bad} differences; unmatched keys: {sorted(set(ORACLE) - set(REGISTRY))}")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
