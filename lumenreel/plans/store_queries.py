"""Queries over clips, jobs, schedules, notices, preferences and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import jobs as J
from ..operators import lineage as N
from ..operators import series as W
from .registry import query
from .views import read

DAY = "DATE '1998-01-01'"
NEWEST = "(SELECT *, row_number() OVER (PARTITION BY coalesce(lineage_id, id) ORDER BY version DESC, id) AS place FROM {clips})"


def day(text="1998-01-01"):
    return F.lit(text).cast("date")


def clips(spark, sf_dir):
    return read(spark, sf_dir, "clips")


@query("newest_per_lineage", f"SELECT id FROM {NEWEST} n WHERE place = 1")
def _(spark, sf_dir):
    return N.newest_per_lineage(clips(spark, sf_dir)).select("id")


COLLECT = f"(SELECT id, size_bytes, CASE WHEN place = 1 THEN NULL WHEN review = 'REJECTED' THEN 'rejected' WHEN {DAY} - superseded_on >= 30 THEN 'superseded' END AS reason FROM {NEWEST} n)"


@query("collectable", f"SELECT id, reason FROM {COLLECT} c")
def _(spark, sf_dir):
    return N.collectable(clips(spark, sf_dir), day(), 30).select("id", "reason")


@query("tidy_report", f"SELECT reason, count(*) AS clips, CAST(sum(CAST(trunc(size_bytes) AS BIGINT)) AS BIGINT) AS bytes FROM {COLLECT} c WHERE reason IS NOT NULL GROUP BY reason")
def _(spark, sf_dir):
    return N.tidy_report(clips(spark, sf_dir), day(), 30)


@query("review_queue", "SELECT id, version FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(lineage_id, id) ORDER BY version DESC, id) AS place FROM {clips} WHERE review = 'PENDING' AND superseded_on IS NULL) n WHERE place = 1")
def _(spark, sf_dir):
    return N.review_queue(clips(spark, sf_dir), "PENDING").select("id", "version")


@query("lineage_peers", "SELECT id FROM {clips} WHERE coalesce(lineage_id, id) IN (SELECT coalesce(lineage_id, id) FROM {clips} WHERE superseded_on IS NOT NULL)")
def _(spark, sf_dir):
    c = clips(spark, sf_dir)
    return N.lineage_peers(c, c.filter("superseded_on IS NOT NULL")).select("id")


@query("settled_clips", "SELECT id FROM {clips} WHERE review = 'REJECTED' UNION SELECT id FROM {clips} WHERE superseded_on IS NOT NULL")
def _(spark, sf_dir):
    return N.settled_clips(clips(spark, sf_dir)).select("id")


@query("lineage_settlement", f"""SELECT c.id, CASE WHEN d.decision = 'REJECTED' THEN 'REJECTED' ELSE c.review END AS review FROM {{clips}} c JOIN (SELECT coalesce(lineage_id, id) AS root, arg_max(id, id) AS id, arg_max(review, id) AS decision FROM {{clips}} WHERE superseded_on IS NOT NULL GROUP BY 1) d
  ON coalesce(c.lineage_id, c.id) = d.root WHERE c.id <> d.id AND d.decision IN ('REJECTED', 'APPROVED')""")
def _(spark, sf_dir):
    c = clips(spark, sf_dir)
    d = c.filter("superseded_on IS NOT NULL").select(N.root().alias("root"), "id", F.col("review").alias("decision"), day().alias("decided_on"))
    return N.lineage_settlement(c, d).select("id", "review")


@query("evict_to_target", """SELECT path, target_met FROM (SELECT id AS path, sum(b) OVER (PARTITION BY owner % 10) >= 2000000 AS target_met, coalesce(sum(b) OVER (PARTITION BY owner % 10 ORDER BY created_on, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT *, CAST(trunc(size_bytes) AS BIGINT) AS b FROM {clips} WHERE id % 7 <> 0 AND id % 11 <> 0) c) x WHERE before < 2000000""")
def _(spark, sf_dir):
    files = clips(spark, sf_dir).select((F.col("owner") % 10).alias("workspace"), F.col("id").alias("path"), F.col("size_bytes").cast("long").alias("size_bytes"), F.col("created_on").alias("last_access"), (F.col("id") % 7 == 0).alias("pinned"), (F.col("id") % 11 == 0).alias("in_use"))
    return N.evict_to_target(files, F.lit(2_000_000)).select("path", "target_met")


@query("orphan_files", "SELECT CAST(p_partkey AS VARCHAR) || '.mp3' AS path FROM {part} WHERE p_partkey % 4 <> 0 AND p_partkey % 3 <> 0")
def _(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    files = part.select(F.concat(F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 3 == 0, ".txt").otherwise(".mp3")).alias("path"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("modified"))
    name = F.concat(F.col("p_partkey").cast("string"), F.lit(".mp3"))
    tracks = part.filter("p_partkey % 4 = 0").select(name.alias("audio"), F.lit(None).cast("string").alias("wide"), name.alias("tall"))
    return N.orphan_files(files, tracks, F.lit("2024-01-02 00:00:00").cast("timestamp"), ("mp3",)).select("path")


@query("referenced_paths", "SELECT CAST(p_partkey AS VARCHAR) AS path FROM {part} UNION SELECT p_brand FROM {part}")
def _(spark, sf_dir):
    return N.referenced_paths(read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("audio"), F.lit(None).cast("string").alias("wide"), F.col("p_brand").alias("tall")))


def attempts(spark, sf_dir):
    """Orders as publish attempts: a customer is a clip."""
    o = read(spark, sf_dir, "orders")
    s = F.when(F.col("o_orderpriority").startswith("1") & (F.col("o_orderstatus") == "F"), "PUBLISHED").when(F.col("o_orderstatus") == "P", "UPLOADING").otherwise("FAILED")
    return o.select(F.col("o_orderkey").alias("publication_id"), F.col("o_custkey").alias("clip_id"), F.lit("youtube").alias("platform"), s.alias("state"), F.col("o_orderdate").alias("created_at"), "o_orderkey")


ATTEMPTS = "(SELECT o_orderkey AS publication_id, o_custkey AS clip_id, CASE WHEN o_orderpriority LIKE '1%' AND o_orderstatus = 'F' THEN 'PUBLISHED' WHEN o_orderstatus = 'P' THEN 'UPLOADING' ELSE 'FAILED' END AS state, o_orderdate AS created_at FROM {orders})"


@query("live_attempt", f"""SELECT clip_id, publication_id FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY created_at NULLS FIRST, publication_id NULLS FIRST) AS rn
  FROM {ATTEMPTS} a WHERE state IN ('PUBLISHED', 'UPLOADING')) b WHERE rn = 1""")
def _(spark, sf_dir):
    return N.live_attempt(attempts(spark, sf_dir)).select("clip_id", "publication_id")


@query("publish_state", f"""SELECT c.c_custkey AS clip_id, CASE WHEN p.pub > 0 THEN 'PUBLISHED' WHEN p.up > 0 THEN 'UPLOADING' WHEN j.status = 'RUNNING' THEN 'UPLOADING' WHEN j.not_before > TIMESTAMP '1997-01-01' THEN 'SCHEDULED' WHEN j.status IS NOT NULL THEN 'QUEUED' WHEN p.bad > 0 THEN 'FAILED' ELSE 'READY' END AS state
  FROM {{customer}} c LEFT JOIN (SELECT clip_id, count(*) FILTER (WHERE state = 'PUBLISHED') AS pub, count(*) FILTER (WHERE state = 'UPLOADING') AS up, count(*) FILTER (WHERE state = 'FAILED') AS bad FROM {ATTEMPTS} a GROUP BY 1) p ON p.clip_id = c.c_custkey
  LEFT JOIN (SELECT * FROM (SELECT trend_id, status, not_before, row_number() OVER (PARTITION BY trend_id ORDER BY created_at DESC, id DESC) AS rn FROM {{jobs}} WHERE status IN ('QUEUED', 'RUNNING')) q WHERE rn = 1) j ON j.trend_id = c.c_custkey""")
def _(spark, sf_dir):
    jobs = read(spark, sf_dir, "jobs").withColumnRenamed("trend_id", "clip_id")
    return N.publish_state(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("clip_id")), attempts(spark, sf_dir), jobs, F.lit("1997-01-01").cast("date"))


@query("publish_gate", "SELECT id, CASE WHEN id % 13 = 0 THEN 'PUBLISHING_DISABLED' WHEN review <> 'APPROVED' THEN 'NOT_APPROVED' END AS refusal FROM {clips}")
def _(spark, sf_dir):
    return clips(spark, sf_dir).select("id", N.publish_gate(F.col("review"), F.col("id") % 13 != 0).alias("refusal"))


@query("layered_metadata", """SELECT c_custkey AS clip_id, coalesce(nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN '  ' END), ''), nullif(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, ''), 'Untitled') || ' | ch' AS title,
  CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 2 = 0 THEN 'clip' ELSE 'channel' END AS tags, CASE WHEN c_custkey % 4 = 0 THEN 'public' ELSE 'unlisted' END AS privacy FROM {customer}""")
def _(spark, sf_dir):
    k = F.col("c_custkey")
    empty = F.array().cast("array<string>")
    rows = read(spark, sf_dir, "customer").select(
        k.alias("clip_id"), F.when(k % 3 == 0, F.col("c_name")).when(k % 3 == 1, "  ").alias("option_title"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("clip_title"), F.lit(" | ch").alias("title_suffix"),
        F.lit(None).cast("string").alias("option_description"), F.lit(" ").alias("clip_description"), F.when(k % 4 == 0, "public").alias("option_privacy"), F.lit("unlisted").alias("channel_privacy"),
        F.when(k % 5 == 0, empty).alias("option_tags"), F.when(k % 2 == 0, F.array(F.lit(" clip "), F.lit(" "))).otherwise(empty).alias("clip_tags"), F.array(F.lit("channel")).alias("channel_tags"),
    )
    return N.layered_metadata(rows).select("clip_id", "title", F.array_join("tags", ",").alias("tags"), "privacy")


@query("parent_window", "SELECT o.o_orderkey AS clip_id, CASE WHEN o.o_orderkey % 2 = 0 THEN 1.0 ELSE s.start_sec END AS start_sec FROM {orders} o LEFT JOIN (SELECT p_partkey, CAST(p_size AS DOUBLE) AS start_sec FROM {part}) s ON s.p_partkey = o.o_custkey")
def _(spark, sf_dir):
    cand = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("start_sec"), F.lit(9.0).alias("end_sec"))
    c = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("clip_id"), F.col("o_custkey").alias("candidate_id"), F.when(F.col("o_orderkey") % 2 == 0, 1.0).alias("remake_start"), F.lit(None).cast("double").alias("remake_end"))
    return N.parent_window(c, cand).select("clip_id", "start_sec")


@query("default_channel", "SELECT s_nationkey AS uid, arg_min(s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN s_suppkey ELSE 1000000 + s_suppkey END) AS id FROM {supplier} GROUP BY 1")
def _(spark, sf_dir):
    return N.default_channel(read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("uid"), F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 9 == 0).alias("is_default"), F.col("s_suppkey").alias("position"))).select("uid", "id")


@query("split_plan", """SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY start_sec, end_sec) AS part, n AS parts, start_sec, end_sec, min(bad) OVER (PARTITION BY clip_id) AS reason, least(0.0, min(start_sec) OVER (PARTITION BY clip_id)) AS start_delta,
  greatest(0.0, max(end_sec) OVER (PARTITION BY clip_id) - 600) AS end_delta FROM (SELECT *, CASE WHEN n > 20 THEN 'too many parts' WHEN end_sec - start_sec < 1 THEN 'too short' WHEN start_sec < -30 THEN 'starts too early' WHEN end_sec > 630 THEN 'ends too late' END AS bad
  FROM (SELECT order_id AS clip_id, start_sec - 20 AS start_sec, end_sec - 22 AS end_sec, count(*) OVER (PARTITION BY order_id) AS n FROM {candidates}) a) b""")
def _(spark, sf_dir):
    r = read(spark, sf_dir, "candidates").select(F.col("order_id").alias("clip_id"), F.lit(600.0).alias("clip_sec"), (F.col("start_sec") - 20).alias("start_sec"), (F.col("end_sec") - 22).alias("end_sec"))
    return N.split_plan(r)


NOW = "1996-06-01 12:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


@query("scan_spec", "SELECT id, status FROM {jobs} WHERE status IN ('QUEUED', 'RUNNING') ORDER BY created_at DESC, id DESC LIMIT 50")
def _(spark, sf_dir):
    return J.scan_spec(read(spark, sf_dir, "jobs"), ["QUEUED", "RUNNING"], 50).select("id", "status")


@query("count_spec", "SELECT status, count(*) AS n FROM {jobs} GROUP BY status")
def _(spark, sf_dir):
    return J.count_spec(read(spark, sf_dir, "jobs"))


@query("tab_counts", "SELECT count(*) FILTER (WHERE status IN ('QUEUED', 'RUNNING')) AS open, count(*) FILTER (WHERE status = 'COMPLETED') AS done FROM {jobs}")
def _(spark, sf_dir):
    return J.tab_counts(read(spark, sf_dir, "jobs"), "status", {"open": ["QUEUED", "RUNNING"], "done": ["COMPLETED"]})


@query("event_log_scan", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE), event_id) AS place FROM {events}")
def _(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.to_date("ts").alias("at"), F.col("event_id").alias("seq"))
    return J.event_log_scan(e).select(F.col("seq").alias("event_id"), "place")


LAPSED = f"(status = 'RUNNING' AND (lease_expires IS NULL OR lease_expires <= TIMESTAMP '{NOW}'))"


@query("lease_lapsed", f"SELECT id, {LAPSED} AS lapsed FROM {{jobs}}")
def _(spark, sf_dir):
    return read(spark, sf_dir, "jobs").select("id", J.lease_lapsed(now()).alias("lapsed"))


@query("lapsed_leases", f"SELECT id FROM {{jobs}} WHERE {LAPSED}")
def _(spark, sf_dir):
    return read(spark, sf_dir, "jobs").filter(J.lease_lapsed(now())).select("id")


@query("job_claimable", f"SELECT id FROM {{jobs}} WHERE (not_before IS NULL OR not_before <= TIMESTAMP '{NOW}') AND (status = 'QUEUED' OR ({LAPSED} AND attempts + 1 < max_attempts))")
def _(spark, sf_dir):
    return read(spark, sf_dir, "jobs").filter(J.job_claimable(now())).select("id")


@query("fifo_claimable", f"SELECT id FROM {{jobs}} WHERE status = 'QUEUED' AND (not_before IS NULL OR not_before <= TIMESTAMP '{NOW}') AND NOT (id % 3 = 0 AND attempts = 1)")
def _(spark, sf_dir):
    jobs = read(spark, sf_dir, "jobs")
    return J.fifo_claimable(jobs, jobs.filter("id % 3 = 0").select("id", F.lit(1).alias("attempts")), now()).select("id")


@query("next_due_time", f"SELECT min(CASE WHEN status = 'QUEUED' AND not_before > TIMESTAMP '{NOW}' THEN not_before END) AS next_start, min(CASE WHEN status = 'RUNNING' AND lease_expires > TIMESTAMP '{NOW}' THEN lease_expires END) AS next_lapse FROM {{jobs}}")
def _(spark, sf_dir):
    return J.next_due_time(read(spark, sf_dir, "jobs"), now())


ZONES = ("Europe/London", "America/New_York", "Mars/Base", "Europe/Berlin", "Asia/Kathmandu", "Australia/Lord_Howe", "America/St_Johns")


def schedules(spark, sf_dir):
    s = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(
        s.alias("id"), F.when(s % 4 == 0, "INTERVAL").otherwise("DAILY").alias("cadence"), F.format_string("%02d:30", s % 24).alias("at"), F.get(F.array(*map(F.lit, ZONES)), (s % len(ZONES)).cast("int")).alias("timezone"),
        (s % 12 + 1).cast("int").alias("every_hours"), (s % 5 != 0).alias("enabled"), F.when(s % 7 != 0, F.timestamp_seconds(F.lit(1711843200) + s * 600)).alias("next_due_at"),
    )


def at(text="2024-03-31 00:15:00"):
    return F.lit(text).cast("timestamp")


@query("schedule_due", """SELECT id, CASE WHEN k = 'INTERVAL' THEN TIMESTAMP '2024-03-31 00:15:00' + to_hours(every) ELSE CAST(timezone('UTC', timezone(zone, w + CASE WHEN w <= l THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END)) AS TIMESTAMP) END AS due, CASE WHEN k = 'DAILY' AND id % 7 = 2 THEN 'unknown zone read as UTC' END AS warning FROM
  (SELECT *, CAST(l AS DATE) + to_hours(id % 24) + INTERVAL 30 MINUTE AS w FROM (SELECT *, timezone(zone, timezone('UTC', TIMESTAMP '2024-03-31 00:15:00')) AS l FROM (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'INTERVAL' ELSE 'DAILY' END AS k, CAST(s_suppkey % 12 + 1 AS INT) AS every,
  CASE s_suppkey % 7 WHEN 0 THEN 'Europe/London' WHEN 1 THEN 'America/New_York' WHEN 3 THEN 'Europe/Berlin' WHEN 4 THEN 'Asia/Kathmandu' WHEN 5 THEN 'Australia/Lord_Howe' WHEN 6 THEN 'America/St_Johns' ELSE 'UTC' END AS zone FROM {supplier}) a) b) c""")
def _(spark, sf_dir):
    return J.schedule_due(schedules(spark, sf_dir), at()).withColumn("due", F.col("due").cast("timestamp_ntz"))


def tried(spark, sf_dir):
    s = schedules(spark, sf_dir)
    return s.filter("id % 2 = 0").select("id", F.col("next_due_at").alias("due_at"), F.timestamp_seconds(F.lit(1711843200) + F.col("id") * 400).alias("retry_at"))


SCHEDULES = "(SELECT s_suppkey AS id, s_suppkey % 5 <> 0 AS enabled, CASE WHEN s_suppkey % 7 <> 0 THEN 1711843200 + s_suppkey * 600 END AS due, CASE WHEN s_suppkey % 2 = 0 THEN 1711843200 + s_suppkey * 400 END AS retry, 1711879200 AS t FROM {supplier})"
WAKE = "CASE WHEN enabled THEN CASE WHEN retry IS NOT NULL THEN greatest(coalesce(due, t), retry) ELSE coalesce(due, t) END END"


@query("schedule_may_fire", f"SELECT id, enabled AND (due IS NULL OR due <= t) AND (retry IS NULL OR t >= retry) AS may_fire, CAST(make_timestamp(CAST({WAKE} AS BIGINT) * 1000000) AS TIMESTAMP) AS wake FROM {SCHEDULES} s")
def _(spark, sf_dir):
    return J.schedule_may_fire(schedules(spark, sf_dir), tried(spark, sf_dir), at("2024-03-31 10:00:00")).withColumn("wake", F.col("wake").cast("timestamp_ntz"))


@query("next_wake", f"SELECT CAST(make_timestamp(CAST(min({WAKE}) AS BIGINT) * 1000000) AS TIMESTAMP) AS next_wake FROM {SCHEDULES} s")
def _(spark, sf_dir):
    return J.next_wake(schedules(spark, sf_dir), tried(spark, sf_dir), at("2024-03-31 10:00:00")).withColumn("next_wake", F.col("next_wake").cast("timestamp_ntz"))


def staged(spark, sf_dir):
    i = F.col("id")
    stage = lambda n, s: F.struct(F.lit(n).alias("name"), s.alias("status"))
    stages = F.array(stage("DOWNLOAD", F.lit("DONE")), stage("ANALYZE", F.when(i % 3 == 0, "RUNNING").when(i % 3 == 1, "DONE").otherwise("FAILED")), stage("RENDER", F.when(i % 6 == 1, "SKIPPED").otherwise("PENDING")))
    return read(spark, sf_dir, "jobs").withColumn("stages", stages)


@query("stage_progress", "SELECT id, CASE WHEN id % 6 = 1 THEN 3 WHEN id % 3 = 1 THEN 2 ELSE 1 END AS done, 3 AS total, CASE WHEN id % 3 = 0 THEN 'ANALYZE' END AS current FROM {jobs}")
def _(spark, sf_dir):
    return staged(spark, sf_dir).select("id", J.stage_progress(F.col("stages")).alias("p")).select("id", "p.*")


@query("job_note", "SELECT id, CASE WHEN status = 'COMPLETED' AND id % 4 = 0 THEN 'nothing worth cutting' WHEN status <> 'COMPLETED' AND id % 3 = 0 THEN 'ANALYZE' WHEN id % 3 = 2 THEN 'ANALYZE' END AS note FROM {jobs}")
def _(spark, sf_dir):
    return staged(spark, sf_dir).select("id", J.job_note(F.col("status"), F.col("stages"), F.col("id") % 4).alias("note"))


@query("call_stats", "SELECT event_type, count(*) AS calls, count(*) FILTER (WHERE event_id % 10 < 7) AS ok, count(*) FILTER (WHERE event_id % 10 = 7) AS repaired, count(*) FILTER (WHERE event_id % 10 > 7) AS failed, round(count(*) FILTER (WHERE event_id % 10 < 7) / count(*), 4) AS ok_rate, round(avg(value), 3) AS mean_seconds FROM {events} GROUP BY event_type")
def _(spark, sf_dir):
    k = F.col("event_id") % 10
    calls = read(spark, sf_dir, "events").select("event_type", F.when(k < 7, "ok").when(k == 7, "repaired").otherwise("failed").alias("outcome"), F.col("value").alias("seconds"))
    return J.call_stats(calls, ["event_type"]).select("event_type", "calls", "ok", "repaired", "failed", F.round("ok_rate", 4).alias("ok_rate"), F.round("mean_seconds", 3).alias("mean_seconds"))


@query("trend_activity", """SELECT j.trend_id, count(*) FILTER (WHERE j.status IN ('QUEUED', 'RUNNING')) AS running, CAST(coalesce(sum(c.pending), 0) AS BIGINT) AS to_review, CAST(coalesce(sum(c.approved), 0) AS BIGINT) AS approved, count(*) FILTER (WHERE j.status = 'COMPLETED' AND c.job_id IS NULL) AS empty
  FROM {jobs} j LEFT JOIN (SELECT owner * 4 AS job_id, count(*) FILTER (WHERE review = 'PENDING') AS pending, count(*) FILTER (WHERE review = 'APPROVED') AS approved FROM {clips} GROUP BY 1) c ON c.job_id = j.id GROUP BY j.trend_id""")
def _(spark, sf_dir):
    return J.trend_activity(read(spark, sf_dir, "jobs"), clips(spark, sf_dir).select((F.col("owner") * 4).alias("job_id"), "review"))


@query("job_end_notice", "SELECT id, CASE WHEN id % 8 = 0 THEN 'JOB_FAILED' WHEN id % 8 = 1 THEN 'PUBLISHED' ELSE 'CLIPS_READY' END AS kind FROM {jobs} WHERE status = 'COMPLETED' AND (id % 8 IN (0, 1) OR id % 5 > 0)")
def _(spark, sf_dir):
    i = F.col("id")
    jobs = read(spark, sf_dir, "jobs").filter("status = 'COMPLETED'").select("id", F.when(i % 8 == 0, "FAILED").otherwise("COMPLETED").alias("status"), F.when(i % 8 == 1, "PUBLISH").otherwise("CLIP").alias("type"))
    return J.job_end_notice(jobs, jobs.select("id", (i % 5).alias("made"))).select("id", "kind")


@query("notice_inbox", "SELECT user_id AS uid, event_type AS kind, arg_max(event_id, event_id) AS seq FROM {events} WHERE user_id % 4 <> 0 AND user_id % 5 <> 0 GROUP BY user_id, event_type, CAST(ts AS DATE)")
def _(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    notices = e.select(F.col("user_id").alias("uid"), F.col("event_type").alias("kind"), F.to_date("ts").cast("string").alias("fold"), F.col("event_id").cast("string").alias("title"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    users = e.select(F.col("user_id").alias("uid")).distinct().select("uid", (F.col("uid") % 4 != 0).alias("approved"), (F.col("uid") % 5 != 0).alias("switched_on"))
    return J.notice_inbox(notices, users).select("uid", "kind", F.col("title").cast("long").alias("seq"))


@query("admin_audience", "SELECT c_custkey AS uid FROM {customer} WHERE c_custkey % 3 = 0 AND c_mktsegment = 'BUILDING'")
def _(spark, sf_dir):
    u = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid"), (F.col("c_custkey") % 3 == 0).alias("approved"), F.when(F.col("c_mktsegment") == "BUILDING", "admin").otherwise("user").alias("role"))
    return J.admin_audience(u)


def preferences(spark, sf_dir):
    p = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(p.alias("id"), F.when(p % 100 == 0, "EVERYTHING").otherwise("SOURCE").alias("scope"), (p % 40).alias("source_id"), F.initcap("p_type").alias("lesson"), F.when(p % 2 == 0, "ACCEPTED").otherwise("PROPOSED").alias("status"), F.when(p % 3 == 0, F.col("p_brand")).alias("voice"), F.when(p % 5 == 0, F.col("p_size")).alias("framing"), p.alias("created_at"), F.col("p_size").alias("size"))


@query("preference_scope", "SELECT s.source_id, p_partkey AS id FROM (SELECT unnest(generate_series(0, 39)) AS source_id) s JOIN {part} p ON p_partkey % 100 = 0 OR p_partkey % 40 = s.source_id")
def _(spark, sf_dir):
    return J.preference_scope(preferences(spark, sf_dir), preferences(spark, sf_dir).select("source_id").distinct())


@query("accepted_preferences", "SELECT s.source_id, p_partkey AS id FROM (SELECT unnest(generate_series(0, 39)) AS source_id) s JOIN {part} p ON p_partkey % 2 = 0 AND (p_partkey % 100 = 0 OR p_partkey % 40 = s.source_id)")
def _(spark, sf_dir):
    return J.preference_scope(preferences(spark, sf_dir).filter("status = 'ACCEPTED'"), preferences(spark, sf_dir).select("source_id").distinct())


@query("preference_dedupe", "SELECT min(p_partkey) AS id FROM {part} WHERE p_partkey % 2 = 1 AND lower(p_type) NOT IN (SELECT lower(p_type) FROM {part} WHERE p_partkey % 2 = 0 AND p_size = 1) GROUP BY lower(p_type)")
def _(spark, sf_dir):
    p = preferences(spark, sf_dir)
    return J.preference_dedupe(p.filter("status = 'PROPOSED'"), p.filter("status = 'ACCEPTED' AND size = 1")).select("id")


@query("preference_defaults", "SELECT p_partkey % 40 AS source_id, arg_max(CASE WHEN p_partkey % 3 = 0 THEN p_brand END, CASE WHEN p_partkey % 3 = 0 THEN p_partkey END) AS voice, arg_max(CASE WHEN p_partkey % 5 = 0 THEN p_size END, CASE WHEN p_partkey % 5 = 0 THEN p_partkey END) AS framing FROM {part} WHERE p_partkey % 2 = 0 GROUP BY 1")
def _(spark, sf_dir):
    return J.preference_defaults(preferences(spark, sf_dir).filter("status = 'ACCEPTED'"), ("voice", "framing"))


BOXES = "(SELECT p_partkey AS id, p_partkey % 50 AS source_id, p_partkey % 83 AS x, p_partkey % 47 AS y, p_partkey % 29 + 5 AS w, p_partkey % 23 + 5 AS h FROM {part})"
MEET = "least(a.x + a.w, b.x + b.w) > greatest(a.x, b.x) AND least(a.y + a.h, b.y + b.h) > greatest(a.y, b.y) AND (least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) / least(a.w * a.h, b.w * b.h) >= 0.3"


@query("known_region_anti", f"SELECT a.source_id, count(*) AS new FROM {BOXES} a WHERE a.id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM {BOXES} b WHERE b.id % 2 = 1 AND b.source_id = a.source_id AND {MEET}) GROUP BY 1")
def _(spark, sf_dir):
    from ..operators.regions import known_region_anti, regions_of_parts

    r = regions_of_parts(read(spark, sf_dir, "part"))
    return known_region_anti(r.filter("id % 2 = 0"), r.filter("id % 2 = 1"))


@query("merge_regions")
def _(spark, sf_dir):
    from ..operators.regions import merge_regions, regions_of_parts

    return merge_regions(regions_of_parts(read(spark, sf_dir, "part")).withColumn("priority", F.col("id") % 3))


@query("use_counter", "SELECT l_suppkey AS source_id, count(DISTINCT l_orderkey) AS use_count, max(l_shipdate) AS last_access FROM {lineitem} GROUP BY 1")
def _(spark, sf_dir):
    return J.use_counter(read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_orderkey").alias("job_id"), F.col("l_shipdate").alias("at")))


@query("applied_counter", "SELECT l_partkey AS id, count(*) + 1 AS times_applied FROM {lineitem} GROUP BY 1")
def _(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg((F.count(F.lit(1)) + 1).alias("times_applied"))


@query("waiting_alert", f"SELECT id FROM {{jobs}} WHERE status = 'QUEUED' AND created_at <= TIMESTAMP '{NOW}' - INTERVAL 10 MINUTE AND id % 6 <> 0")
def _(spark, sf_dir):
    jobs = read(spark, sf_dir, "jobs")
    return J.waiting_alerts(jobs, jobs.filter("id % 6 = 0").select("id"), F.lit(NOW).cast("timestamp")).select("id")


@query("presence", "SELECT user_id, CASE WHEN user_id % 7 = 0 THEN 'unknown' WHEN user_id % 3 = 0 THEN 'online' WHEN user_id % 2 = 0 THEN 'offline' ELSE 'checking' END AS presence FROM {events} GROUP BY user_id")
def _(spark, sf_dir):
    u = F.col("user_id")
    c = read(spark, sf_dir, "events").select("user_id").distinct().select("user_id", F.lit("t").alias("token"), u.alias("agent_id"), F.when(u % 7 != 0, u).alias("report_agent"), F.when(u % 3 == 0, "t").alias("answered_ping"), F.lit(1).alias("last_seen"), F.lit(1).alias("seen_before"), (u % 2 == 0).alias("expired"))
    return c.select("user_id", J.agent_presence(c).alias("presence"))


@query("freshest_beat", "SELECT user_id, arg_max(event_id, event_id) AS event_id FROM {events} GROUP BY user_id")
def _(spark, sf_dir):
    stamp = F.try_to_timestamp(F.col("ts").cast("string"))
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct(stamp, "event_id")).alias("event_id")).orderBy(F.desc_nulls_last("event_id"))


@query("sources_by_use", "SELECT l_suppkey AS source_id, count(*) AS uses FROM {lineitem} GROUP BY 1 ORDER BY uses DESC, source_id")
def _(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("source_id")).agg(F.count(F.lit(1)).alias("uses")).orderBy(F.desc("uses"), "source_id")


@query("kept_source", "SELECT p_partkey, p_partkey % 9 = 0 OR p_size > 1 AS kept, CASE WHEN p_partkey % 2 = 0 THEN 'video' ELSE 'music' END AS kind FROM {part}")
def _(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", ((F.col("p_partkey") % 9 == 0) | (F.col("p_size") > 1)).alias("kept"), F.coalesce(F.when(F.col("p_partkey") % 2 == 1, "music"), F.lit("video")).alias("kind"))


@query("source_dedupe", "SELECT l_suppkey AS provider, l_partkey AS external_id FROM {lineitem} WHERE l_orderkey % 2 = 0 EXCEPT SELECT l_suppkey, l_partkey FROM {lineitem} WHERE l_orderkey % 2 = 1")
def _(spark, sf_dir):
    x = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("provider"), F.col("l_partkey").alias("external_id"), F.col("l_shipdate").alias("submitted_at"), F.col("l_linenumber").alias("id"), "l_orderkey")
    return J.source_dedupe(x.filter("l_orderkey % 2 = 0"), x.filter("l_orderkey % 2 = 1"), ("provider", "external_id")).select("provider", "external_id")


#: 97 views for each order key: below a thousand, thousands and, from key 10310 on, tenths of millions.
COMPACT = """CASE WHEN o_orderkey * 97 >= 1000000 THEN regexp_replace(printf('%d.%d', round(o_orderkey * 97 / 1e5)::BIGINT // 10, round(o_orderkey * 97 / 1e5)::BIGINT % 10), '\\.0$', '') || 'M'
  WHEN o_orderkey * 97 >= 1000 THEN CAST(CAST(floor(o_orderkey * 97 / 1000.0 + 0.5) AS BIGINT) AS VARCHAR) || 'K' ELSE CAST(o_orderkey * 97 AS VARCHAR) END"""


@query("readable", f"SELECT o_orderkey, {COMPACT} AS views FROM {{orders}}")
def _(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", J.readable_views(F.col("o_orderkey") * 97).alias("views"))


@query("readable_duration", "SELECT o_orderkey, CASE WHEN o_orderkey >= 3600 THEN CAST(o_orderkey // 3600 AS VARCHAR) || ':' || lpad(CAST(o_orderkey % 3600 // 60 AS VARCHAR), 2, '0') ELSE CAST(o_orderkey // 60 AS VARCHAR) END || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') AS length FROM {orders}")
def _(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", J.readable_duration(F.col("o_orderkey")).alias("length"))


@query("readable_age", "SELECT ord, CASE WHEN age_hours IS NULL THEN NULL WHEN age_hours < 1 THEN 'just now' WHEN age_hours < 24 THEN CAST(CAST(age_hours AS BIGINT) AS VARCHAR) || 'h ago' WHEN age_hours < 336 THEN CAST(CAST(floor(age_hours / 24 + 0.5) AS BIGINT) AS VARCHAR) || 'd ago' ELSE CAST(CAST(floor(age_hours / 168 + 0.5) AS BIGINT) AS VARCHAR) || 'w ago' END AS age FROM {video_hits}")
def _(spark, sf_dir):
    return read(spark, sf_dir, "video_hits").select("ord", J.readable_age(F.col("age_hours")).alias("age"))


@query("song_length", "SELECT p_partkey, CAST(greatest(30, least(300, ceil((2 + 2 * (p_size % 9) + 8 + CASE WHEN p_size % 9 = 0 THEN 8 ELSE 0 END) * 240.0 / (60 + p_size) / 5) * 5)) AS INT) AS seconds FROM {part}")
def _(spark, sf_dir):
    verse = F.concat(F.lit("[Verse 1]\n"), F.repeat(F.lit("la la\n"), (F.col("p_size") % 9).cast("int")), F.lit("\n[Solo]\n"))
    return read(spark, sf_dir, "part").select("p_partkey", J.song_seconds(verse, F.col("p_size") + 60).alias("seconds"))


SERIES = "(SELECT user_id AS series_id, CAST(date_diff('hour', TIMESTAMP '2024-01-01', ts) // 6 AS BIGINT) AS t, round(sum(value), 4) AS value FROM {events} GROUP BY 1, 2)"


def series(spark, sf_dir):
    """Quarter days of each user: as many series as there are users."""
    quarters = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200) / 21600).cast("long")
    return read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("series_id"), quarters.alias("t")).agg(F.round(F.sum("value"), 4).alias("value"))


@query("loudest_window", f"""SELECT series_id, t AS start FROM (SELECT series_id, t, row_number() OVER (PARTITION BY series_id ORDER BY s DESC NULLS LAST, t) AS rn FROM
  (SELECT series_id, t, sum(CAST(abs(value) AS DECIMAL(28, 6))) OVER (PARTITION BY series_id ORDER BY t RANGE BETWEEN CURRENT ROW AND 5 FOLLOWING) AS s FROM {SERIES} x) y) z WHERE rn = 1""")
def _(spark, sf_dir):
    return W.loudest_window(series(spark, sf_dir), 6)


@query("best_window_profile", f"""SELECT series_id, t AS "left" FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY abs(t + 6.0 - centroid), t) AS rn FROM (SELECT *, max(mass) OVER (PARTITION BY series_id) AS best FROM
  (SELECT series_id, t, sum(value) OVER w AS mass, count(*) OVER w AS n, sum(t * value) OVER (PARTITION BY series_id) / nullif(sum(value) OVER (PARTITION BY series_id), 0) AS centroid FROM {SERIES} s WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)) a
  WHERE n = 12) b WHERE mass >= best - greatest(1e-9, abs(best) * 1e-6)) c WHERE rn = 1""")
def _(spark, sf_dir):
    return W.best_window_profile(series(spark, sf_dir), 12).select("series_id", "left")


@query("peak_section", f"""SELECT p.series_id, coalesce(max(b.t), p.t) AS start FROM (SELECT series_id, t FROM (SELECT series_id, t, row_number() OVER (PARTITION BY series_id ORDER BY mass DESC, t) AS rn FROM (SELECT series_id, t, sum(value) OVER w AS mass, count(*) OVER w AS n FROM {SERIES} s
  WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)) a WHERE n = 12) c WHERE rn = 1) p LEFT JOIN {SERIES} b ON b.series_id = p.series_id AND b.t % 7 = 0 AND b.t <= p.t GROUP BY p.series_id, p.t""")
def _(spark, sf_dir):
    s = series(spark, sf_dir)
    return W.peak_section(s, s.filter("t % 7 = 0").select("series_id", F.col("t").alias("beat")), 12)


@query("shared_scale_curves", f"SELECT series_id, t, round(value / (SELECT greatest(1.0, max(value)) FROM {SERIES} z), 6) AS scaled FROM {SERIES} x")
def _(spark, sf_dir):
    return W.shared_scale(series(spark, sf_dir), "value").select("series_id", "t", F.round("scaled", 6).alias("scaled"))


@query("smooth_path")
def _(spark, sf_dir):
    return W.smooth_path(series(spark, sf_dir), 5, 20.0)


@query("simplify_path")
def _(spark, sf_dir):
    return W.simplify_path(series(spark, sf_dir), 50.0)


@query("lag_correlations", f"""SELECT a.series_id, b.t - a.t AS lag, round(sum((a.value - m.mean) * (b.value - m.mean)) / any_value(m.v0), 6) AS r FROM {SERIES} a JOIN {SERIES} b ON a.series_id = b.series_id AND b.t - a.t BETWEEN 2 AND 30
  JOIN (SELECT series_id, avg(value) AS mean, sum((value - mv) * (value - mv)) AS v0 FROM (SELECT *, avg(value) OVER (PARTITION BY series_id) AS mv FROM {SERIES} x) y GROUP BY 1) m ON m.series_id = a.series_id GROUP BY 1, 2""")
def _(spark, sf_dir):
    return W.lag_correlations(series(spark, sf_dir), 2, 30).select("series_id", F.col("lag").cast("long").alias("lag"), F.round("r", 6).alias("r"))


@query("dominant_period", f"""SELECT series_id, CASE WHEN n >= 32 AND strength >= 0.15 AND strength > 1.5 * mean THEN lag END AS period, round(strength, 6) AS strength FROM (SELECT series_id, any_value(n) AS n, max(r) AS strength, avg(r) AS mean, arg_max(lag, (r, -lag)) AS lag FROM
  (SELECT a.series_id, b.t - a.t AS lag, any_value(m.n) AS n, sum((a.value - m.mean) * (b.value - m.mean)) / any_value(m.v0) AS r FROM {SERIES} a JOIN {SERIES} b ON a.series_id = b.series_id AND b.t - a.t BETWEEN 2 AND 30
  JOIN (SELECT series_id, count(*) AS n, any_value(mv) AS mean, sum((value - mv) * (value - mv)) AS v0 FROM (SELECT *, avg(value) OVER (PARTITION BY series_id) AS mv FROM {SERIES} x) y GROUP BY 1) m ON m.series_id = a.series_id GROUP BY 1, 2) z GROUP BY 1) d""")
def _(spark, sf_dir):
    found = W.dominant_period(series(spark, sf_dir), 2, 30)
    return found.select("series_id", F.col("period").cast("long").alias("period"), F.round("strength", 6).alias("strength"))


@query("phase_grid", f"SELECT series_id, arg_max(o, m * 100000 - o) AS \"offset\" FROM (SELECT series_id, t % 24 AS o, avg(value) AS m FROM {SERIES} x GROUP BY 1, 2) y GROUP BY 1")
def _(spark, sf_dir):
    return W.phase_grid(series(spark, sf_dir), 24)


@query("motion_profile", "SELECT label, d AS \"column\", round(sum(CASE WHEN c > 0.1 THEN c ELSE 0 END), 4) AS energy FROM (SELECT label, d, abs(v - lag(v) OVER (PARTITION BY label, d ORDER BY vec_id)) AS c FROM (SELECT label, vec_id, unnest(generate_series(1, len(embedding))) AS d, embedding[unnest(generate_series(1, len(embedding)))]::DOUBLE AS v FROM {embeddings}) a) b GROUP BY 1, 2")
def _(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("p", "v"))
    f = e.select(F.col("label").alias("series_id"), "frame", (F.col("p") + 1).cast("long").alias("column"), F.col("v").cast("double").alias("value"))
    return W.motion_profile(f, 0.1).select(F.col("series_id").alias("label"), "column", F.round("energy", 4).alias("energy"))


@query("slice_keyframes")
def _(spark, sf_dir):
    s = series(spark, sf_dir)
    k = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("part")
    parts = s.select("series_id").distinct().select("series_id", k).select("series_id", "part", (F.col("part") * 100 + 0.5).alias("p0"), (F.col("part") * 100 + 60.25).alias("p1"))
    return W.slice_keyframes(s, parts)


@query("speaking_at", "SELECT c.conv_id AS scene_id, q.at_sec AS \"at\", (SELECT arg_min(role, turn) FROM {conversations} d WHERE d.conv_id = c.conv_id AND d.turn = CAST(floor(q.at_sec / 10) AS BIGINT)) AS speaker FROM (SELECT DISTINCT conv_id FROM {conversations}) c, (VALUES (5.0::DOUBLE), (15.0), (95.0)) q(at_sec)")
def _(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("scene_id"), (F.col("turn") * 10.0).alias("start_sec"), (F.col("turn") * 10.0 + 10).alias("end_sec"), F.col("role").alias("speaker"))
    times = c.select("scene_id").distinct().select("scene_id", F.explode(F.array(F.lit(5.0), F.lit(15.0), F.lit(95.0))).alias("at"))
    return W.speaking_at(c, times)


@query("scene_times", """SELECT script_id, scene, first_line_sec, 200.0::DOUBLE AS total_sec, start_sec, coalesce(lead(start_sec) OVER (PARTITION BY script_id ORDER BY scene), 200.0) AS end_sec FROM (SELECT *, max(s) OVER (PARTITION BY script_id ORDER BY scene) AS start_sec FROM
  (SELECT conv_id AS script_id, turn AS scene, CASE WHEN turn % 3 <> 1 THEN turn * 4.0::DOUBLE END AS first_line_sec, coalesce(min(CASE WHEN turn % 3 <> 1 THEN turn * 4.0::DOUBLE END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 200.0) AS s FROM {conversations}) a) b""")
def _(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    s = c.select(F.col("conv_id").alias("script_id"), F.col("turn").alias("scene"), F.when(F.col("turn") % 3 != 1, F.col("turn") * 4.0).alias("first_line_sec"), F.lit(200.0).alias("total_sec"))
    return W.time_scenes(s)


@query("retention_at", f"""SELECT series_id, round_even(CASE WHEN 60 <= t0 THEN v0 WHEN 60 >= t9 THEN v9 WHEN a = b THEN va ELSE va + (60 - a) / (b - a)::DOUBLE * (vb - va) END, 4) AS half FROM (SELECT series_id, min(t) AS t0, arg_min(value, t) AS v0, max(t) AS t9, arg_max(value, t) AS v9,
  max(t) FILTER (WHERE t <= 60) AS a, arg_max(value, t) FILTER (WHERE t <= 60) AS va, min(t) FILTER (WHERE t >= 60) AS b, arg_min(value, t) FILTER (WHERE t >= 60) AS vb FROM {SERIES} s GROUP BY series_id) x""")
def _(spark, sf_dir):
    s = series(spark, sf_dir).groupBy("series_id").agg(F.collect_list(F.struct((F.col("t") / 120).alias("x"), F.col("value").alias("y"))).alias("curve"))
    return s.select("series_id", F.bround(W.interpolate(F.col("curve"), 0.5), 4).alias("half"))


@query("category_lookup", "SELECT s.s_suppkey, n.n_name AS code, r.r_name AS grp FROM {supplier} s LEFT JOIN {nation} n ON n.n_nationkey = s.s_nationkey + 5 LEFT JOIN {region} r ON r.r_regionkey = n.n_regionkey")
def _(spark, sf_dir):
    catalogue = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = read(spark, sf_dir, "supplier").withColumn("k", F.col("s_nationkey") + 5)
    return s.join(catalogue, F.col("k") == F.col("n_nationkey"), "left").select("s_suppkey", F.col("n_name").alias("code"), F.col("r_name").alias("grp"))
