"""Section 2.8 run as streams: the events table arrives in three parts, each taken by a run of its own over one checkpoint."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.selection import shared_folder
from ..streaming import counters, deliver, groups, timers
from .registry import query
from .trend_queries import _fingerprinted, records
from .views import expand, read

#: Where the parts begin.
PARTS = ("2024-01-11", "2024-01-21")
HOUR = 3_600_000


def in_parts(spark: SparkSession, rows: DataFrame, at: str, run: Callable[[DataFrame, str], object]) -> str:
    """Appends rows to a folder part by part of the column `at`, and after each runs a stream over the folder to its end. run gets
    the stream and the folder for its checkpoint and results, which is returned."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    low, high = (F.lit(p).cast("timestamp") for p in PARTS)
    for part in (F.col(at) < low, (F.col(at) >= low) & (F.col(at) < high), F.col(at) >= high):
        rows.filter(part).write.mode("append").parquet(f"{folder}/in")
        run(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), folder).awaitTermination()
    return folder


def _to_table(found: DataFrame, folder: str):
    return found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


JOB_EVENTS = """(SELECT CAST(floor(event_id / 4.0) AS BIGINT) AS id, CAST(floor(event_id / 4.0) AS BIGINT) % 5 AS worker, ts AS moment,
  CASE WHEN event_id % 4 = 0 THEN 'QUEUED' WHEN event_type = 'click' THEN 'RUNNING' WHEN event_type = 'purchase' THEN 'COMPLETED' ELSE 'QUEUED' END AS status
  FROM {events} WHERE event_id % 4 = 0 OR event_type <> 'error')"""
WORKER_EVENTS = "(SELECT user_id % 5 AS worker, CASE WHEN event_id % 2 = 0 THEN 'WORKING' ELSE 'IDLE' END AS status, ts AS moment FROM {events} WHERE event_id % 4 <> 0 AND event_type = 'error')"


@query(
    "waiting_alert_stream",
    f"""WITH j AS (SELECT *, epoch_us(moment) // 1000 AS ms FROM {JOB_EVENTS} x), w AS (SELECT *, epoch_us(moment) // 1000 AS ms FROM {WORKER_EVENTS} x),
    horizon AS (SELECT max(ms) - {HOUR} AS h FROM (SELECT ms FROM j UNION ALL SELECT ms FROM w)),
    s AS (SELECT *, coalesce(lag(status) OVER o, '') <> 'QUEUED' AS begins, count(CASE WHEN status = 'COMPLETED' THEN 1 END) OVER o AS epoch,
      min(CASE WHEN status <> 'QUEUED' THEN ms END) OVER (PARTITION BY id ORDER BY ms, status ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS until
      FROM j WINDOW o AS (PARTITION BY id ORDER BY ms, status)),
    d AS (SELECT id, worker, epoch, ms, ms + 600000 AS due, until FROM s WHERE status = 'QUEUED' AND begins),
    t AS (SELECT d.*, CASE WHEN coalesce((SELECT arg_max(status, ms) FROM w WHERE w.worker = d.worker AND w.ms <= d.due), 'IDLE') <> 'WORKING' THEN d.due
      ELSE (SELECT min(ms) FROM w WHERE w.worker = d.worker AND w.ms > d.due AND w.status <> 'WORKING') END AS told FROM d)
    SELECT worker, id, min(ms) AS queued_ms, min(told) AS told_ms FROM (SELECT *, row_number() OVER (PARTITION BY id, epoch ORDER BY told) AS rn FROM t, horizon
      WHERE told <= h AND (until IS NULL OR told < until)) x WHERE rn = 1 GROUP BY worker, id, epoch""",
)
def _(spark, sf_dir):
    sql = lambda text: spark.sql(expand(text, lambda t: f"parquet.`{sf_dir}/{t}.parquet`").strip()[1:-1]).withColumnRenamed("moment", "at")
    none = F.lit(None).cast("long")
    rows = sql(JOB_EVENTS).withColumn("kind", F.lit("job")).unionByName(sql(WORKER_EVENTS).withColumn("kind", F.lit("worker")).withColumn("id", none))

    def run(stream, folder):
        found = timers.stream_waiting_alerts(stream.filter("kind = 'job'"), stream.filter("kind = 'worker'"), delay="1 hour", shards=4)
        return _to_table(found, folder)

    folder = in_parts(spark, rows, "at", run)
    found = spark.read.schema("worker long, id long, queued_at timestamp, told_at timestamp").parquet(f"{folder}/out")
    return found.select("worker", "id", F.unix_millis("queued_at").alias("queued_ms"), F.unix_millis("told_at").alias("told_ms"))


LEASE_EVENTS = "(SELECT user_id AS id, CASE event_type WHEN 'click' THEN 'CLAIM' WHEN 'purchase' THEN 'END' ELSE 'HEARTBEAT' END AS kind, ts AS moment, ts + INTERVAL 12 HOUR AS lease_until FROM {events} WHERE event_type <> 'error')"


@query(
    "lapsed_leases_stream",
    f"""WITH e AS (SELECT id, kind, epoch_us(moment) // 1000 AS ms, epoch_us(lease_until) // 1000 AS until FROM {LEASE_EVENTS} x), horizon AS (SELECT max(ms) - {HOUR} AS h FROM e),
    r AS (SELECT *, count(CASE WHEN kind <> 'HEARTBEAT' THEN 1 END) OVER o AS run, count(CASE WHEN kind = 'END' THEN 1 END) OVER o AS lives, lag(until) OVER o AS last_until, lead(ms) OVER o AS next_ms
      FROM e WINDOW o AS (PARTITION BY id ORDER BY ms, kind, until)),
    v AS (SELECT *, first_value(kind) OVER o AS opens, count(CASE WHEN kind = 'HEARTBEAT' AND ms > last_until THEN 1 END) OVER o AS broken, count(CASE WHEN kind = 'CLAIM' THEN 1 END) OVER (PARTITION BY id, lives ORDER BY ms, kind, until) AS claims
      FROM r WINDOW o AS (PARTITION BY id, run ORDER BY ms, kind, until))
    SELECT id, until AS lapsed_ms, claims FROM v, horizon WHERE opens = 'CLAIM' AND broken = 0 AND ms <= h AND until <= h AND (next_ms IS NULL OR until < next_ms)""",
)
def _(spark, sf_dir):
    rows = spark.sql(expand(LEASE_EVENTS, lambda t: f"parquet.`{sf_dir}/{t}.parquet`").strip()[1:-1]).withColumnRenamed("moment", "at")
    folder = in_parts(spark, rows, "at", lambda stream, folder: _to_table(timers.stream_lapsed_leases(stream, "1 hour"), folder))
    found = spark.read.schema("id long, lapsed_at timestamp, claims long").parquet(f"{folder}/out")
    return found.select("id", F.unix_millis("lapsed_at").alias("lapsed_ms"), "claims")


@query(
    "log_groups_stream",
    f"""SELECT fingerprint, count(*) AS count, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, arg_max(message, (ts, event_id)) AS message, 'OPEN' AS status,
    array_to_string(list_reverse(list(event_id ORDER BY ts DESC, event_id DESC)[1:25]), ',') AS kept FROM {_fingerprinted()} r GROUP BY fingerprint""",
)
def _(spark, sf_dir):
    def run(stream, folder):
        def keep(batch, batch_id):
            batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

        found = groups.stream_log_groups(stream)
        return found.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()

    folder = in_parts(spark, records(spark, sf_dir), "ts", run)
    rows = spark.read.schema(f"{groups.OUT}, batch int").parquet(f"{folder}/out")
    last = rows.groupBy("fingerprint").agg(F.max_by(F.struct("count", "first_us", "last_us", "message", "status", "kept"), "batch").alias("g"))
    kept = F.array_join(F.transform("g.kept", lambda o: o.event_id.cast("string")), ",").alias("kept")
    return last.select("fingerprint", "g.count", "g.first_us", "g.last_us", "g.message", "g.status", kept)


CHANGES = StructType([StructField(n, LongType() if n in ("id", "version") else StringType()) for n in ("id", "version", "lane", "status")])


@query(
    "live_query_stream",
    """SELECT lane, id, version FROM (SELECT user_id AS id, event_id AS version, concat('lane', CAST(event_id % 3 AS VARCHAR)) AS lane, event_type AS status,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM {events} WHERE event_id % 50 <> 7) x WHERE rn = 1 AND status IN ('view', 'click')""",
)
def _(spark, sf_dir):
    e = F.col("event_id")
    document = F.to_json(F.struct(F.col("user_id").alias("id"), e.alias("version"), F.concat(F.lit("lane"), (e % 3).cast("string")).alias("lane"), F.col("event_type").alias("status")))
    rows = read(spark, sf_dir, "events").select("ts", F.when(e % 50 == 7, F.lit("{not a document")).otherwise(document).alias("value"))

    def run(stream, folder):
        live = deliver.LiveQuery(f"{folder}/live", CHANGES, ("id", "version", "lane"), F.col("status").isin("view", "click"), "lane", compact=2)
        return deliver.stream_live_query(stream.select("value"), live, f"{folder}/checkpoint")

    folder = in_parts(spark, rows, "ts", run)
    rows = spark.read.option("basePath", f"{folder}/live/delivered").schema(StructType([*CHANGES.fields, StructField("batch", LongType())])).parquet(f"{folder}/live/delivered")
    changed = spark.read.schema("lane string, n long, digest string, at_batch long").parquet(f"{folder}/live/changed")
    last = changed.groupBy("lane").agg(F.max("at_batch").alias("batch"))
    return rows.join(last, ["lane", "batch"]).select("lane", "id", "version")


@query("use_counter_stream", "SELECT user_id AS counted, count(DISTINCT event_id % 40) AS n, epoch_us(max(ts)) // 1000 AS last_ms FROM {events} GROUP BY 1")
def _(spark, sf_dir):
    uses = read(spark, sf_dir, "events").select(F.col("user_id").alias("counted"), (F.col("event_id") % 40).alias("by"), F.col("ts").alias("at"))
    folder = in_parts(spark, uses, "at", lambda stream, folder: counters.stream_counts(stream, f"{folder}/counts", f"{folder}/checkpoint", keep_ms=60 * 24 * HOUR))
    return counters.read_counts(spark, f"{folder}/counts").select("counted", "n", F.unix_millis("last_at").alias("last_ms"))
