"""Small hand-made frames."""

from datetime import timedelta

from tests.conftest import ts
from tidemark import schemas
from tidemark.schemas import METRICS
from tidemark.store import Store, empty_table


def frame(spark, name, data):
    """Rows of a store table; of facts as their snapshots have them."""
    return spark.createDataFrame(data, schemas.SNAPSHOTS.get(name, schemas.STORE_TABLES[name]))


def runtime(spark, data):
    """Runtime rows from ``(query_id, interval_id, count, total)``; other columns follow.

    Every metric's total is ``total``; min, max and last are 1, 2 and 3.  A
    fifth element sets the last execution time.
    """
    out = []
    for query_id, interval_id, count, total, *rest in data:
        last = rest[0] if rest else ts() + timedelta(hours=interval_id - 1)
        out.append((query_id, interval_id, ts(), last, count, *([total, 3, 1, 2, 0] * len(METRICS))))
    return frame(spark, "query_runtime_stats", out)


def averaged(spark, data):
    """Already differenced rows from ``(query_id, interval_id, count, average)``."""
    out = [
        (q, i, ts(), ts() + timedelta(hours=i - 1), n, *([avg * n, 3, 1, 2, avg] * len(METRICS)))
        for q, i, n, avg in data
    ]
    return frame(spark, "query_runtime_stats", out)


def waits(spark, data):
    """Wait rows from ``(interval_id, wait_type, tasks, time)``."""
    return frame(spark, "wait_stats", [(i, w, n, t, t, n) for i, w, n, t in data])


def hours(spark, n, day=1):
    """``n`` hourly intervals from midnight, the last one open."""
    start = ts(day=day)
    return frame(
        spark,
        "intervals",
        [
            (i, start + timedelta(hours=i - 1), start + timedelta(hours=i) if i < n else None)
            for i in range(1, n + 1)
        ],
    )


def plans(spark, data):
    """Plan rows from ``(plan_id, database, object type)``."""
    return spark.createDataFrame(
        data, "plan_id long, plan_database string, plan_objecttype string"
    )


def queries(spark, data):
    """Query rows from ``(query_id, plan_id, hash)``."""
    return spark.createDataFrame(data, "query_id long, plan_id long, query_hash binary")


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "query_id long")


def wait_filter(spark, *names):
    return spark.createDataFrame([(n, True) for n in names], schemas.WAIT_TYPE_FILTER)


def store(spark, **frames):
    base = {name: empty_table(spark, name) for name in schemas.STORE_TABLES}
    return Store(**{**base, **frames})
