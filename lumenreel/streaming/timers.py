"""What happens when nothing arrives: alerts for jobs that wait and leases that lapse, by timers on event time.

Rows of a key are held until the watermark has passed them and are then taken in the order of their times, so results don't
depend on how a stream was cut into batches. A key has one timer, for the earliest of its held rows and of what falls due.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WAIT_MINUTES, SHARDS = 10, 64
#: Stands for no time in stored lists, whose numbers have no nulls.
NEVER = -(1 << 63)


class InOrder(StatefulProcessor):
    """Takes a key's rows in order. Subclasses give the rows' columns after `ms` and their types, the results' names, and
    advance(key, rows, now): results of rows up to now and of all that falls due up to now, and when something next does."""

    columns: tuple[str, ...]
    types: str
    results: tuple[str, ...]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", f"ms long, {self.types}")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def advance(self, key: tuple, rows: list[tuple], now: int) -> tuple[list[tuple], int | None]:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [row for frame in rows for row in _tuples(frame, ("ms", *self.columns))]
        self.held.appendList(new)
        self._wake(min(row[0] for row in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = [tuple(row) for row in self.held.get()]
        ready, later = sorted(r for r in rows if r[0] <= now), [r for r in rows if r[0] > now]
        _store(self.held, later)
        found, due = self.advance(key, ready, now)
        coming = [t for t in (due, *(r[0] for r in later)) if t is not None]
        if coming:
            self._wake(max(min(coming), now + 1), now)
        if found:
            yield pd.DataFrame(found, columns=list(self.results))

    def _wake(self, ms: int, gone: int = -1) -> None:
        """Sets the key's timer, unless an earlier one is set; those up to `gone` have fired."""
        set_for = [t for t in self.handle.listTimers() if t > gone]
        if set_for and min(set_for) <= ms:
            return
        for t in set_for:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(ms)

    def close(self) -> None:
        pass


def _time(stored: int) -> int | None:
    return None if stored == NEVER else stored


def _store(state, rows: list[tuple]) -> None:
    """Puts rows in a list's place."""
    if rows:
        state.put(rows)
    else:
        state.clear()


def _tuples(frame: pd.DataFrame, columns: tuple[str, ...]) -> list[tuple]:
    """Rows of a frame; numbers have no nulls, as pandas would make floats of their columns."""
    return list(zip(*(frame[c].tolist() for c in columns), strict=True))


class WaitingJobs(InOrder):
    """The waiting jobs of a worker's shard, which of them somebody was told of, and whether the worker works."""

    columns, types = ("kind", "id", "status"), "kind string, id long, status string"
    results = ("worker", "id", "queued_ms", "told_ms")

    def __init__(self, wait_ms: int):
        self.wait = wait_ms

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.jobs = handle.getListState("jobs", "id long, since long, told boolean")
        self.working = handle.getValueState("working", "working boolean")

    def advance(self, key: tuple, rows: list[tuple], now: int) -> tuple[list[tuple], int | None]:
        jobs = {job: (_time(since), told) for job, since, told in self.jobs.get()}
        working = bool(self.working.exists() and self.working.get()[0])
        found: list[tuple] = []
        clock = None
        # when jobs that wait will have waited long enough; a job that is queued no longer stays until it is met
        due = [(since + self.wait, job) for job, (since, told) in jobs.items() if since is not None and not told]
        heapq.heapify(due)

        def waits(at: int, job: int) -> bool:
            since, told = jobs.get(job, (None, True))
            return not told and since is not None and since + self.wait == at

        def tell(until: int) -> None:
            """Alerts of the time from clock on, before `until`."""
            while not working and due and due[0][0] < until and (clock is None or clock < until):
                at, job = heapq.heappop(due)
                if waits(at, job):
                    found.append((key[0], job, at - self.wait, at if clock is None else max(at, clock)))
                    jobs[job] = (at - self.wait, True)

        for ms, kind, job, status in rows:
            tell(ms)
            clock = ms
            if kind == "worker":
                working = status == "WORKING"
            elif status == "QUEUED":
                since, told = jobs.get(job, (None, False))
                if since is None and not told:
                    heapq.heappush(due, (ms + self.wait, job))
                jobs[job] = (ms if since is None else since, told)
            elif status == "RUNNING":
                jobs[job] = (None, jobs.get(job, (None, False))[1])
            else:
                jobs.pop(job, None)
        tell(now + 1)
        _store(self.jobs, [(job, NEVER if since is None else since, told) for job, (since, told) in jobs.items()])
        self.working.update((working,))
        while due and not waits(*due[0]):
            heapq.heappop(due)
        return found, due[0][0] if due and not working else None


def stream_waiting_alerts(jobs: DataFrame, workers: DataFrame, minutes: float = WAIT_MINUTES, delay: str = "1 hour", shards: int = SHARDS) -> DataFrame:
    """worker, id, queued_at, told_at: each job that has been queued for `minutes` while its worker doesn't work, once.

    jobs has worker, id, status and at (QUEUED, RUNNING, or any other for a job that is over); workers has worker, status (WORKING
    or any other) and at. A job needs no further row to be told of: a timer is set for when it will have waited long enough,
    and nothing is said if it is claimed before. While the worker works alerts are held back until it stops. A job that is claimed
    and queued again isn't told of again; one that ends is forgotten. A worker that was never heard of doesn't work. Jobs of a worker are
    dealt to `shards` keys, so that a busy one doesn't burden one task; its own few rows go to all of them. Rows later than `delay` after
    the newest are dropped.
    """
    at = F.col("at").cast("timestamp").alias("at")
    j = jobs.select("worker", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit("job").alias("kind"), F.col("id").cast("long").alias("id"), "status", at)
    w = workers.select("worker", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit("worker").alias("kind"), F.lit(-1).cast("long").alias("id"), "status", at)
    rows = j.unionByName(w).withColumn("ms", F.unix_millis("at")).withWatermark("at", delay)
    processor = WaitingJobs(int(minutes * 60_000))
    found = rows.groupBy("worker", "shard").transformWithStateInPandas(processor, "worker long, id long, queued_ms long, told_ms long", "Append", "EventTime")
    return found.select("worker", "id", F.timestamp_millis("queued_ms").alias("queued_at"), F.timestamp_millis("told_ms").alias("told_at"))


class Leases(InOrder):
    """The leases of a shard's jobs: until when each runs, or that there is none, and how often it was claimed."""

    columns, types = ("id", "kind", "lease_ms"), "id long, kind string, lease_ms long"
    results = ("id", "lapsed_ms", "claims")

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.leases = handle.getListState("leases", "id long, until long, claims long")

    def advance(self, key: tuple, rows: list[tuple], now: int) -> tuple[list[tuple], int | None]:
        leases = {job: (_time(until), claims) for job, until, claims in self.leases.get()}  # no lease: None
        found = []
        # in the order of time, then kind, within each job
        for ms, job, kind, lease in rows:
            until, claims = leases.get(job, (None, 0))
            if until is not None and until < ms:
                found.append((job, until, claims))
                until = None
            if kind == "CLAIM":
                until, claims = lease, claims + 1
            elif kind == "HEARTBEAT":
                until = until if until is None else lease
            else:
                until, claims = None, 0
            if claims:
                leases[job] = (until, claims)
            else:
                leases.pop(job, None)
        for job, (until, claims) in leases.items():
            if until is not None and until <= now:
                found.append((job, until, claims))
                leases[job] = (None, claims)
        _store(self.leases, [(job, NEVER if until is None else until, claims) for job, (until, claims) in leases.items()])
        return found, min((until for until, _ in leases.values() if until is not None), default=None)


def stream_lapsed_leases(events: DataFrame, delay: str = "1 hour", shards: int = SHARDS) -> DataFrame:
    """id, lapsed_at, claims (how often it was claimed): each lease that ends without a heartbeat or an end up to then, once.

    events has id, kind (CLAIM, HEARTBEAT, or any other for a job that is over), at and lease_until. Every heartbeat moves the
    timer; one that comes after its lease has lapsed is of no use, and the job has no lease until it is claimed again. A job that
    is over is forgotten. Jobs are dealt to `shards` keys of the state; the number stays with a checkpoint.
    """
    at, until = (F.col(c).cast("timestamp") for c in ("at", "lease_until"))
    rows = events.select(F.col("id").cast("long").alias("id"), "kind", F.coalesce(F.unix_millis(until), F.lit(-1)).alias("lease_ms"), at.alias("at"), F.unix_millis(at).alias("ms")).withWatermark("at", delay)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    found = rows.groupBy("shard").transformWithStateInPandas(Leases(), "id long, lapsed_ms long, claims long", "Append", "EventTime")
    return found.select("id", F.timestamp_millis("lapsed_ms").alias("lapsed_at"), "claims")
