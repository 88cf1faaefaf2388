from datetime import date

from pyspark.sql import functions as F

from lumenreel.operators import logs as L
from lumenreel.streaming import groups as G
from lumenreel.streaming import live as V
from lumenreel.streaming import snapshots as S


def test_streams_match_their_batch_twins(spark, tmp_path):
    rows = [(i, f"app{i % 2}", "error", f"request {i} failed", float(i * 7 % 400), None) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, app string, level string, message string, second double, stack string")
    path = str(tmp_path / "in")
    for k in range(2):
        df.filter(F.col("event_id") % 2 == k).coalesce(1).write.mode("append").parquet(path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = V.file_stream(spark, path, df.schema, 10)
    groups = V.drain(G.stream_log_groups(stream.withColumn("ts", F.timestamp_micros((F.col("second") * 1e6).cast("long")))), "groups", str(tmp_path / "c1"), "update").collect()
    assert sum(g["count"] for g in groups) == 60 and len({g.fingerprint for g in groups}) == 2
    got = V.drain(V.stream_rate_limit(stream, 5, 60.0), "rates", str(tmp_path / "c2")).collect()
    timed = df.withColumn("ts", F.timestamp_micros((F.col("second") * 1e6).cast("long")))
    want = L.rate_limit(timed, 5, 60.0).collect()
    assert sorted((r.event_id, r.accepted) for r in got) == sorted((r.event_id, r.accepted) for r in want)


def test_restatement_stream(spark, tmp_path):
    schema = "publication_id long, day date, views long, partial boolean"
    path, store = str(tmp_path / "in"), S.SnapshotStore(str(tmp_path / "out"), schema)
    day = lambda n: date(2024, 1, n)

    def arrive(rows):
        spark.createDataFrame(rows, schema + ", seq long").coalesce(1).write.mode("append").parquet(path)
        V.file_stream(spark, path, schema + ", seq long").writeStream.foreachBatch(store).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.day.day, r.views, r.partial) for r in store.read(spark).collect())

    assert arrive([(1, day(1), 5, False, 1), (1, day(2), 5, True, 1)]) == [(1, 5, False), (2, 5, True)]
    assert arrive([(1, day(1), 9, True, 2), (1, day(2), 9, True, 2)]) == [(1, 5, False), (2, 9, True)]
    store.compact(spark)
    assert arrive([(1, day(2), 7, False, 3), (1, day(2), 8, False, 2), (1, day(3), None, None, 3)]) == [(1, 5, False), (2, 7, False), (3, None, None)]
