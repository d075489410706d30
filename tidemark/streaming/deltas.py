"""Differencing snapshots as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from tidemark.operators.deltas import RUNTIME_COUNTERS
from tidemark.schemas import METRICS, QUERY_RUNTIME_STATS, WAIT_COUNTERS, WAIT_STATS

RUNTIME_AVERAGES = {f"avg_{m}": f"total_{m}" for m in METRICS}


#: Neighbouring numeric keys that share a call of the state function; a few, as it holds what a batch brings for them.
KEYS_PER_GROUP = 16


def _stepper(
    key: str, schema: T.StructType, counters: tuple[str, ...], averages: dict[str, str], wait_ms: int
) -> Callable:
    """State function of a group of keys: the newest snapshot of each is held back until the next arrives.

    A group's input is what one micro-batch brings for its keys: a row per key
    and interval.  Everything is one integer matrix, a column per field after
    one for the key (0 in a group of a single key, which is text or NULL).
    The state is such a matrix too, with the time of the last news of each key.
    """
    numeric = isinstance(schema[key].dataType, T.LongType)
    fields = ["_key", *[f.name for f in schema.fields if f.name != key]]
    times = [f.name for f in schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    at_counters = [fields.index(c) for c in counters]
    at_averages = [(fields.index(a), fields.index(t)) for a, t in averages.items()]
    at_id, at_runs = fields.index("interval_id"), fields.index(counters[0])

    def step(keys, batches, state):
        import numpy as np
        import pandas as pd

        single = not numeric or pd.isna(keys[0])
        now = state.getCurrentProcessingTimeMs() if wait_ms else 0

        def matrix(pdf):
            return np.column_stack(
                [
                    np.zeros(len(pdf), dtype="int64") if single else pdf[key].to_numpy("int64"),
                    *[
                        pdf[f].astype("datetime64[ns]").astype("int64") if f in times
                        else pdf[f].astype("int64")
                        for f in fields[1:]
                    ],
                ]
            )

        def frame(rows, is_delta):
            out = pd.DataFrame(rows[:, 1:], columns=fields[1:])
            for f in times:
                out[f] = pd.to_datetime(out[f])
            out.insert(0, key, [None if numeric else keys[0]] * len(out) if single else rows[:, 0])
            out["is_delta"] = is_delta
            return out

        width = len(fields)
        state_rows = np.frombuffer(state.get[0], dtype="int64") if state.exists else np.empty(0, dtype="int64")
        held, seen = np.split(state_rows.reshape(-1, width + 1), [width], axis=1)
        rows = np.concatenate([np.empty((0, width), dtype="int64"), *[matrix(pdf) for pdf in batches if len(pdf)]])
        # By key and interval; of several rows of an interval the last in the order of all columns counts.
        others = [rows[:, c] for c in range(1, width) if c != at_id]
        rows = rows[np.lexsort([*others, rows[:, at_id], rows[:, 0]])]
        rows = rows[np.append((rows[1:, [0, at_id]] != rows[:-1, [0, at_id]]).any(axis=1), True)[: len(rows)]]
        news = np.isin(held[:, 0], rows[:, 0])
        done, states = [], []
        if len(held):
            place = np.minimum(np.searchsorted(held[:, 0], rows[:, 0]), len(held) - 1)
            known, newest = held[place, 0] == rows[:, 0], held[place, at_id]
            late = rows[known & (rows[:, at_id] < newest)]
            done.append((late, np.zeros(len(late), dtype=bool)))
            rows = np.concatenate([held[news], rows[~known | (rows[:, at_id] > newest)]])
            rows = rows[np.lexsort([rows[:, at_id], rows[:, 0]])]
        silent, since = held[~news], seen[~news]
        gone = (since[:, 0] + wait_ms <= now) if wait_ms else np.zeros(len(silent), dtype=bool)
        done.append((silent[gone], np.zeros(int(gone.sum()), dtype=bool)))
        states.append(np.column_stack([silent[~gone], since[~gone]]))
        if len(rows):
            followed = rows[1:, 0] == rows[:-1, 0]
            earlier, later = rows[:-1][followed].copy(), rows[1:][followed]
            adjacent = later[:, at_id] == earlier[:, at_id] + 1
            for c in at_counters:
                earlier[:, c] = np.where(adjacent, later[:, c] - earlier[:, c], earlier[:, c])
            runs = earlier[:, at_runs]
            divisor = np.where(runs == 0, 1, runs)
            for a, t in at_averages:
                total = earlier[:, t]
                mean = np.sign(total) * np.sign(divisor) * (np.abs(total) // np.abs(divisor))
                earlier[:, a] = np.where(adjacent, np.where(runs == 0, 0, mean), earlier[:, a])
            done.append((earlier, adjacent))
            last = rows[np.append(~followed, True)]
            states.append(np.column_stack([last, np.full(len(last), now)]))
        kept = np.concatenate(states)
        if len(kept):
            state.update((kept[np.argsort(kept[:, 0])].tobytes(),))
            if wait_ms:
                state.setTimeoutDuration(max(1, int(kept[:, -1].min()) + wait_ms - now))
        elif state.exists:
            state.remove()
        found, is_delta = np.concatenate([r for r, _ in done]), np.concatenate([d for _, d in done])
        if len(found):
            yield frame(found, is_delta)

    return step


def _stream_delta(
    snapshots: DataFrame,
    key: str,
    schema: T.StructType,
    counters: tuple[str, ...],
    averages: dict[str, str],
    wait_ms: int,
) -> DataFrame:
    fields = [f for f in schema.fields if f.name != key]
    output = T.StructType([schema[key], *fields, T.StructField("is_delta", T.BooleanType())])
    held = T.StructType([T.StructField("rows", T.BinaryType())])
    numeric = isinstance(schema[key].dataType, T.LongType)
    group = F.call_function("div", F.col(key), F.lit(KEYS_PER_GROUP)) if numeric else F.col(key)
    timeout = GroupStateTimeout.ProcessingTimeTimeout if wait_ms else GroupStateTimeout.NoTimeout
    return (
        snapshots.select(*schema.names, group.alias("_group"))
        .groupBy("_group")
        .applyInPandasWithState(
            _stepper(key, schema, counters, averages, wait_ms), output, held, "append", timeout
        )
    )


def stream_delta(snapshots: DataFrame, evict_after_ms: int = 0) -> DataFrame:
    """``runtime_delta`` over a stream of runtime snapshots.

    A row comes out when the next snapshot of its query arrives, differenced if
    that is the following interval and as it was otherwise.  With
    ``evict_after_ms`` a query without news for so long gives its last row
    undifferenced and is forgotten.  A snapshot older than the last one seen comes
    out undifferenced as well, so nothing is lost; one of the same interval is
    taken for a repetition.
    """
    return _stream_delta(
        snapshots, "query_id", QUERY_RUNTIME_STATS, RUNTIME_COUNTERS, RUNTIME_AVERAGES, evict_after_ms
    )


def stream_wait_delta(snapshots: DataFrame, evict_after_ms: int = 0) -> DataFrame:
    """``wait_delta`` over a stream of wait snapshots, idle intervals dropped."""
    out = _stream_delta(snapshots, "wait_type", WAIT_STATS, WAIT_COUNTERS, {}, evict_after_ms)
    return out.filter(~(F.col("is_delta") & (F.col("waiting_tasks_count") == 0)))
