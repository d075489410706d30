"""The state function of the streaming deltas by itself: eviction."""

import pandas as pd

from tidemark.schemas import WAIT_COUNTERS, struct, LONG, INT
from tidemark.streaming.deltas import _stepper

SCHEMA = struct(("query_id", LONG), ("interval_id", INT), *[(c, LONG) for c in WAIT_COUNTERS])


class State:
    exists, hasTimedOut, get, now, timeout = False, False, None, 0, None

    def update(self, value):
        self.exists, self.get = True, value

    def remove(self):
        self.exists, self.get = False, None

    def getCurrentProcessingTimeMs(self):
        return self.now

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def test_a_silent_key_is_evicted_and_its_neighbour_stays():
    step, state = _stepper("query_id", SCHEMA, WAIT_COUNTERS, {}, 100), State()

    def call(now, *data):
        state.now = now
        batch = pd.DataFrame([(q, i, n, n, n, n) for q, i, n in data], columns=SCHEMA.names)
        out = [r for pdf in step((0,), iter([batch]), state) for r in pdf.itertuples(index=False)]
        return sorted((r.query_id, r.interval_id, r.waiting_tasks_count, r.is_delta) for r in out)

    assert call(1000, (1, 1, 3), (2, 1, 1)) == [] and state.timeout == 100
    assert call(1050, (2, 2, 4)) == [(2, 1, 3, True)] and state.timeout == 50
    assert call(1100) == [(1, 1, 3, False)] and state.timeout == 50
    assert call(1150) == [(2, 2, 4, False)] and not state.exists
