"""Streams with stored state: log groups, live queries, snapshots and counters, held against their batch twins."""

import random
from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lumenreel.operators import history as H
from lumenreel.operators import logs as L
from lumenreel.streaming import counters as C
from lumenreel.streaming import deliver as D
from lumenreel.streaming import groups as G
from lumenreel.streaming import live as V
from lumenreel.streaming import snapshots as S


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def held(df):
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


RECORD = "event_id long, app string, level string, message string, stack string, ts timestamp, resolves string"
START = datetime(2024, 1, 1)


def test_log_groups_go_on_from_what_is_stored(spark, tmp_path):
    rng = random.Random(3)
    kinds = ["disk full", "no route", "timed out", "bad token", "lost lease"]
    record = lambda i: (i, "app", "error", rng.choice(kinds), rng.choice([None, f"at f{i % 3}"]), START + timedelta(seconds=rng.randint(0, 900)), None)
    batches = [[record(100 * b + i) for i in range(40)] for b in range(4)]
    frames = [L.with_fingerprint(spark.createDataFrame(b, RECORD)) for b in batches]
    names = {r.message: r.fingerprint for r in frames[0].filter("stack IS NULL").select("message", "fingerprint").distinct().collect()}
    stored = L.log_groups(frames[0]).withColumn("status", F.lit("OPEN"))
    resolved = [names["disk full"], names["no route"]]
    stored = held(stored.withColumn("status", F.when(F.col("fingerprint").isin(resolved), "RESOLVED").otherwise("OPEN")))
    # the last batch but one also resolves a group that the last one opens again, and one nobody hears of again
    batches[2] = [r for r in batches[2] if r[3] != "bad token"]
    batches[3] = [r for r in batches[3] if r[3] not in ("lost lease",)]
    frames = [L.with_fingerprint(spark.createDataFrame(b, RECORD)) for b in batches]
    resolving = [(0, None, None, None, None, START, names["bad token"])]
    path = str(tmp_path / "in")
    for b in (1, 2, 3):
        spark.createDataFrame(batches[b] + (resolving if b == 2 else []), RECORD).coalesce(1).write.mode("append").parquet(path)
    stream = V.file_stream(spark, path, RECORD, 1)
    found = G.stream_log_groups(stream.filter("resolves IS NULL"), stream.filter("resolves IS NOT NULL").select(F.col("resolves").alias("fingerprint")), G.stored_groups(stored, L.keep_last_n(frames[0])), 25)
    log = []
    query = found.writeStream.foreachBatch(lambda df, b: log.append((b, df.collect()))).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.fingerprint: r for _, rows in sorted(log) for r in rows}
    merged = stored
    for b in (1, 2, 3):
        if b == 2:
            merged = merged.withColumn("status", F.when(F.col("fingerprint") == names["bad token"], "RESOLVED").otherwise(F.col("status")))
        merged = held(L.merge_groups(merged, L.log_groups(frames[b])))
    union = frames[0]
    for f in frames[1:]:
        union = union.unionByName(f)
    kept = {}
    for r in L.keep_last_n(union).orderBy("ts", "event_id").collect():
        kept.setdefault(r.fingerprint, []).append(r.event_id)
    for r in merged.select("*", F.unix_micros("first_seen").alias("a"), F.unix_micros("last_seen").alias("z")).collect():
        if r.fingerprint in got:
            g = got[r.fingerprint]
            assert (g["count"], g.first_us, g.last_us, g.message, g.stack, g.status, [o.event_id for o in g.kept]) == (r["count"], r.a, r.z, r.message, r.stack, r.status, kept[r.fingerprint])
    assert len(got) > len(names)
    opened = {(b, r.fingerprint) for b, rows in log for r in rows if r.reopened}
    assert {f for _, f in opened} >= set(resolved) | {names["bad token"]}


DOCUMENT = StructType([StructField(n, LongType() if n in ("id", "version") else StringType()) for n in ("id", "version", "lane", "status", "title")])


def deliveries(batches, required=("id", "version", "lane")):
    """Per batch the sets that changed, whole, and how many texts can't be read."""
    import json

    state, told, out = {}, {}, []
    for batch in batches:
        rejects, touched = 0, set()
        for text in batch:
            try:
                d = json.loads(text)
                assert isinstance(d, dict) and all(d.get(k) is not None for k in required) and isinstance(d["id"], int) and isinstance(d["version"], int)
            except (ValueError, AssertionError):
                rejects += 1
                continue
            old = state.get(d["id"])
            touched |= {d["lane"]} | ({old["lane"]} if old else set())
            if old is None or d["version"] > old["version"]:
                state[d["id"]] = d
        now = {lane: frozenset((d["id"], d["version"]) for d in state.values() if d["lane"] == lane and d["status"] == "QUEUED") for lane in touched}
        changed = {lane: s for lane, s in now.items() if s != told.get(lane, frozenset())}
        told |= changed
        out.append((changed, rejects))
    return out


def test_live_query_works_a_set_out_once_a_batch(spark, tmp_path, monkeypatch):
    live = D.LiveQuery(str(tmp_path), DOCUMENT, ("id", "version", "lane"), F.col("status") == "QUEUED", "lane")
    plans, hand_over = [], live.hand_over
    monkeypatch.setattr(live, "hand_over", lambda rows, changed, batch_id: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or hand_over(rows, changed, batch_id))
    for b in range(2):
        live(spark.createDataFrame([(f'{{"id": {i}, "version": {b}, "lane": "x", "status": "QUEUED"}}',) for i in range(5)], "value string"), b)
    assert len(plans) == 2 and not any("Aggregate" in plan for plan in plans)
    assert spark.read.parquet(f"{tmp_path}/delivered/batch=1").count() == 5


def test_live_query_delivers_whole_sets_when_they_change(spark, tmp_path):
    import json

    rng, version = random.Random(5), 0
    batches = []
    for _ in range(5):
        batch = []
        for _ in range(12):
            version += 1
            d = {"id": rng.randint(1, 15), "version": version, "lane": rng.choice("abc"), "status": rng.choice(["QUEUED", "QUEUED", "DONE"]), "title": "t"}
            batch.append(rng.choice([json.dumps(d)] * 9 + ["{broken", json.dumps({**d, "id": "x"}), json.dumps({"id": 1, "version": 5})]))
        batches.append(batch)
    batches[3] = batches[2]  # replayed
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in batches:
        spark.createDataFrame([(t,) for t in batch], "value string").coalesce(1).write.mode("append").parquet(path)
    live = D.LiveQuery(out, DOCUMENT, ("id", "version", "lane"), F.col("status") == "QUEUED", "lane", compact=2)
    D.stream_live_query(V.file_stream(spark, path, "value string", 1), live, str(tmp_path / "c")).awaitTermination()
    want = deliveries(batches)
    assert want[3][0] == {}

    def seen(b):
        sets = {r.lane: set() for r in spark.read.schema(live.digests).parquet(f"{out}/changed/batch={b}").collect()}
        for r in spark.read.schema(DOCUMENT).parquet(f"{out}/delivered/batch={b}").collect():
            sets[r.lane].add((r.id, r.version))
        return {k: frozenset(v) for k, v in sets.items()}, spark.read.schema("value string, reason string").parquet(f"{out}/rejects/batch={b}").count()

    assert [seen(b) for b in range(5)] == want
    live(spark.createDataFrame([(t,) for t in batches[4]], "value string"), 4)  # a batch that is tried again
    assert seen(4) == want[4]


def test_snapshots_read_as_upserts_whatever_is_compacted(spark, tmp_path):
    schema = "publication_id long, day date, views long, partial boolean"
    rng, store, merged = random.Random(2), S.SnapshotStore(str(tmp_path / "s"), schema), None
    opened = []
    for b in range(9):
        today = date(2024, 1, 5) + timedelta(days=b)
        rows = []
        for p in range(4):
            for back in rng.sample(range(12), 6):
                rows.append((p, today - timedelta(days=back), rng.randint(0, 99), rng.choice([back <= 3, False, None]), rng.randint(0, 5) * 10 + len(rows) % 10))
        rows = list({(r[0], r[1], r[4]): r for r in rows}.values())
        batch = spark.createDataFrame(rows, schema + ", seq long")
        last = {}
        for r in sorted(rows, key=lambda r: r[4]):
            last[r[0], r[1]] = r[:4]
        new = spark.createDataFrame(list(last.values()), schema)
        merged = new if merged is None else H.upsert_unsettled(merged, new).drop("written")
        merged = held(merged)
        store(batch, b)
        if b in (2, 3, 6):
            before = store.manifest(spark)[2]
            store.compact(spark)
            after = store.manifest(spark)[2]
            newest = max(after)
            opened += [(d, f) for d, f in before.items() if (newest - d).days > 3 and after[d] != f]
        if b in (3, 5, 8):
            store(batch, b)  # again
            assert Counter(map(tuple, store.read(spark).select("publication_id", "day", "views", "partial").collect())) == Counter(map(tuple, merged.select("publication_id", "day", "views", "partial").collect()))
    assert not opened and len(set(store.manifest(spark)[2].values())) > 1


def test_counts_survive_replays(spark, tmp_path):
    rng = random.Random(6)
    uses = [[(rng.randint(1, 5), rng.randint(1, 9), START + timedelta(minutes=60 * b + rng.randint(0, 59))) for _ in range(30)] for b in range(3)]
    uses.append(uses[1])  # all of it comes again
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in uses:
        spark.createDataFrame(batch, "counted long, by long, at timestamp").coalesce(1).write.mode("append").parquet(path)
    stream = V.file_stream(spark, path, "counted long, by long, at timestamp", 1)
    for _ in range(2):
        C.stream_counts(stream, out, str(tmp_path / "c")).awaitTermination()
        base = spark.createDataFrame([(1, 100, START), (77, 5, START)], "counted long, n long, last_at timestamp")
        got = {r.counted: (r.n, r.last_at) for r in C.read_counts(spark, out, base).collect()}
        flat = [u for b in uses for u in b]
        want = {c: (len({j for k, j, _ in flat if k == c}) + 100 * (c == 1), max(t for k, _, t in flat if k == c)) for c in {u[0] for u in flat}} | {77: (5, START)}
        assert got == want
