"""Stateful processors take many keys' rows in few calls of the state, and in time about in proportion to them."""

import time
from itertools import count

import pandas as pd

from lumenreel.streaming import counters as C
from lumenreel.streaming import timers as T


class Held:
    """A value or a list of a state store that counts how often it is asked or told."""

    def __init__(self, calls):
        self.calls, self.rows = calls, None

    def exists(self):
        return self.rows is not None

    def get(self):
        next(self.calls)
        return self.rows if self.rows is not None else []

    def update(self, rows):
        next(self.calls)
        self.rows = rows

    put = update

    def appendList(self, rows):
        self.update([*(self.rows or []), *rows])

    def clear(self):
        self.rows = None


class Handle:
    def __init__(self):
        self.calls, self.timers = count(), []
        self.getListState = self.getValueState = lambda *_: Held(self.calls)
        self.registerTimer = self.timers.append
        self.deleteTimer = self.timers.remove

    def listTimers(self):
        return iter(list(self.timers))


class Watermark:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def opened(processor):
    handle = Handle()
    processor.init(handle)
    return handle


def test_a_buckets_pairs_are_looked_up_together():
    first = C.FirstUse(1000)
    handle = opened(first)
    uses = pd.DataFrame({"counted": range(5000), "by": 7, "ms": range(5000)})
    (got,) = first.handleInputRows((0,), iter([uses, uses]), None)
    assert got["first"].sum() == len(got) == 5000 and handle.timers == [1000]
    assert not list(first.handleExpiredTimer((0,), Watermark(3000), None)) and handle.timers == [3001]
    (got,) = first.handleInputRows((0,), iter([uses]), None)  # those of 0 to 2000 are forgotten
    assert got[got["first"] == 1]["counted"].tolist() == list(range(2001)) and got["ms"].tolist() == list(range(5000))
    assert next(handle.calls) < 10


def test_many_waiting_jobs_are_told_of_in_one_pass():
    jobs = T.WaitingJobs(10)
    handle = opened(jobs)
    n, begun = 20_000, time.monotonic()
    rows = pd.DataFrame({"ms": range(n), "kind": "job", "id": range(n), "status": "QUEUED"})
    assert not list(jobs.handleInputRows((1, 0), iter([rows]), None))
    (got,) = jobs.handleExpiredTimer((1, 0), Watermark(n), None)
    assert got[["id", "queued_ms", "told_ms"]].values.tolist() == [[i, i, i + 10] for i in range(n - 9)]
    assert time.monotonic() - begun < 5 and next(handle.calls) < 20


def test_a_shards_leases_lapse_together():
    leases = T.Leases()
    handle = opened(leases)
    rows = pd.DataFrame({"ms": range(3000), "id": range(3000), "kind": "CLAIM", "lease_ms": range(5000, 8000)})
    assert not list(leases.handleInputRows((0,), iter([rows]), None))
    (got,) = leases.handleExpiredTimer((0,), Watermark(6000), None)
    assert got.values.tolist() == [[i, 5000 + i, 1] for i in range(1001)] and 6001 in handle.timers
    assert next(handle.calls) < 10
