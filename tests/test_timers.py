"""Streams with timers against plain models over the same rows in order."""

import random

import pytest
from pyspark.sql import functions as F

from lumenreel.streaming import live as V
from lumenreel.streaming import timers as T

MINUTE = 60_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def alerts(jobs, workers, wait, horizon):
    """What is told up to the horizon, minute by minute of events: jobs and workers are (ms, key, status)."""
    found, told = [], set()
    for job in {j for _, _, j, _ in jobs}:
        mine = sorted((ms, status, worker) for ms, worker, j, status in jobs if j == job)
        worker = mine[0][2]
        states = sorted((ms, status) for ms, w, status in workers if w == worker)
        spells, since = [], None
        for ms, status, _ in mine:
            if status == "QUEUED":
                since = ms if since is None else since
            else:
                if since is not None:
                    spells.append((since, ms))
                since = None
                if status != "RUNNING":
                    spells.append("over")
        if since is not None:
            spells.append((since, 1 << 60))
        for spell in spells:
            if spell == "over":
                told.discard(job)
                continue
            due = spell[0] + wait
            idle = [due] if ([s for ms, s in states if ms <= due] or ["IDLE"])[-1] != "WORKING" else []
            idle += [ms for ms, s in states if ms > due and s != "WORKING"]
            at = min(idle, default=1 << 60)
            if at < spell[1] and at <= horizon and job not in told:
                found.append((worker, job, spell[0], at))
                told.add(job)
    return sorted(found)


def job_rows(rng, n):
    for job in range(n):
        at, worker = rng.randint(0, 200) * MINUTE, rng.randint(1, 3)
        for _ in range(rng.randint(1, 4)):
            yield at + rng.randint(0, 999), worker, job, rng.choice(["QUEUED", "QUEUED", "RUNNING", "COMPLETED"])
            at += rng.randint(1, 25) * MINUTE


def in_batches(spark, rows, schema, path, rng, batches, spread):
    """Rows in files of about ascending times, each row up to `spread` early or late."""
    order = sorted(rows, key=lambda r: r[0] + rng.randint(-spread, spread))
    size = -(-len(order) // batches)
    for i in range(batches):
        part = spark.createDataFrame(order[i * size : (i + 1) * size], schema).withColumn("at", F.timestamp_millis("ms")).drop("ms").withColumn("batch", F.lit(i))
        part.coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("seed", [1, 2])
def test_waiting_jobs_are_told_of_once(spark, tmp_path, seed):
    rng = random.Random(seed)
    jobs = list(job_rows(rng, 150))
    workers = [(rng.randint(0, 260) * MINUTE + 7, w, rng.choice(["WORKING", "IDLE"])) for w in (1, 2) for _ in range(8)]
    rows = [(ms, w, j, s, "job") for ms, w, j, s in jobs] + [(ms, w, None, s, "worker") for ms, w, s in workers]
    rows.append((400 * MINUTE, 9, 999, "COMPLETED", "job"))
    path, checkpoint = str(tmp_path / "in"), str(tmp_path / "c")
    in_batches(spark, rows, "ms long, worker long, id long, status string, kind string", path, rng, 5, 4 * MINUTE)

    def run():
        stream = V.file_stream(spark, path, spark.read.parquet(path).schema, 1)
        found = T.stream_waiting_alerts(stream.filter("kind = 'job'"), stream.filter("kind = 'worker'"), delay="20 minutes", shards=4)
        query = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r.worker, r.id, r.q, r.t) for r in spark.read.parquet(str(tmp_path / "out")).select("worker", "id", F.unix_millis("queued_at").alias("q"), F.unix_millis("told_at").alias("t")).collect())

    want = alerts(jobs, workers, 10 * MINUTE, 380 * MINUTE)
    assert len(want) > 20 and run() == want
    assert run() == want  # a restart tells nobody again


def lapses(events, horizon):
    found = []
    for job in {e[1] for e in events}:
        until, claims = None, 0
        for ms, _, kind, lease in [*sorted(e for e in events if e[1] == job), (horizon + 1, job, "", None)]:
            if until is not None and until < ms:
                found.append((job, until, claims))
                until = None
            if kind == "CLAIM":
                until, claims = lease, claims + 1
            elif kind == "HEARTBEAT" and until is not None:
                until = lease
            elif kind == "END":
                until, claims = None, 0
    return sorted(found)


def test_leases_lapse_without_a_heartbeat(spark, tmp_path):
    rng = random.Random(5)
    events = []
    for job in range(120):
        at = rng.randint(0, 200) * MINUTE
        for _ in range(rng.randint(1, 7)):
            events.append((at + rng.randint(0, 99), job, rng.choice(["CLAIM", "HEARTBEAT", "HEARTBEAT", "END"]), at + 5 * MINUTE))
            at += rng.randint(1, 8) * MINUTE
    events.append((500 * MINUTE, 999, "END", None))
    path = str(tmp_path / "in")
    in_batches(spark, events, "ms long, id long, kind string, lease_ms long", path, rng, 4, 3 * MINUTE)
    stream = V.file_stream(spark, path, spark.read.parquet(path).schema, 1).withColumn("lease_until", F.timestamp_millis("lease_ms"))
    got = V.drain(T.stream_lapsed_leases(stream, "10 minutes"), "lapses", str(tmp_path / "c")).select("id", F.unix_millis("lapsed_at"), "claims").collect()
    want = lapses(events, 490 * MINUTE)
    assert len(want) > 40 and sorted(map(tuple, got)) == want
