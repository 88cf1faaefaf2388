"""Jobs, leases, schedules, notices, preferences and other store-side reports."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

RETRY_SECONDS = 300


def scan_spec(jobs: DataFrame, statuses: list[str] | None, limit: int) -> DataFrame:
    """A page of jobs of some statuses, newest first."""
    rows = jobs if statuses is None else jobs.filter(F.col("status").isin(*statuses))
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def count_spec(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def tab_counts(rows: DataFrame, column: str, tabs: dict[str, list[str]]) -> DataFrame:
    return rows.agg(*(F.count_if(F.col(column).isin(*values)).alias(tab) for tab, values in tabs.items()))


def event_log_scan(events: DataFrame, job: str = "job_id") -> DataFrame:
    """Events numbered per job by time and, inside one instant, by sequence number."""
    return events.withColumn("place", F.row_number().over(Window.partitionBy(job).orderBy("at", "seq")))


def lease_lapsed(now: Column) -> Column:
    return (F.col("status") == "RUNNING") & (F.col("lease_expires").isNull() | (F.col("lease_expires") <= now))


def job_claimable(now: Column) -> Column:
    due = F.col("not_before").isNull() | (F.col("not_before") <= now)
    return due & ((F.col("status") == "QUEUED") | (lease_lapsed(now) & (F.col("attempts") + 1 < F.col("max_attempts"))))


def fifo_claimable(jobs: DataFrame, refused: DataFrame, now: Column) -> DataFrame:
    due = jobs.filter((F.col("status") == "QUEUED") & (F.col("not_before").isNull() | (F.col("not_before") <= now)))
    return due.join(refused, ["id", "attempts"], "left_anti").orderBy("created_at", "id")


def next_due_time(jobs: DataFrame, now: Column) -> DataFrame:
    """The earliest start and the earliest lapse still ahead."""
    return jobs.agg(
        F.min(F.when((F.col("status") == "QUEUED") & (F.col("not_before") > now), F.col("not_before"))).alias("next_start"),
        F.min(F.when((F.col("status") == "RUNNING") & (F.col("lease_expires") > now), F.col("lease_expires"))).alias("next_lapse"),
    )


DUE = StructType([StructField("micros", LongType()), StructField("known", BooleanType())])


@F.pandas_udf(DUE)
def _next_local(now: pd.Series, at: pd.Series, timezone: pd.Series) -> pd.DataFrame:
    """The next time of day after now in any IANA zone, as wall time, so that clock changes don't move it."""
    rows = []
    for micros, clock, name in zip(now, at, timezone, strict=True):
        try:
            zone, known = ZoneInfo(name or "UTC"), True
        except (ZoneInfoNotFoundError, ValueError, OSError):
            zone, known = UTC, False
        moment = datetime.fromtimestamp(0, UTC) + timedelta(microseconds=int(micros))
        local = moment.astimezone(zone)
        hours, minutes = (int(part) for part in (clock or "0:0").split(":")[:2])
        due = local.replace(hour=hours, minute=minutes, second=0, microsecond=0)
        due += timedelta(days=due <= local)
        rows.append(((due.astimezone(UTC) - datetime.fromtimestamp(0, UTC)) // timedelta(microseconds=1), known))
    return pd.DataFrame(rows, columns=["micros", "known"])


def schedule_due(schedules: DataFrame, now: Column) -> DataFrame:
    """The next firing: the next local time of day in the schedule's zone, daylight saving kept, or now and an interval."""
    daily = _next_local(F.unix_micros(now), F.col("at"), F.col("timezone"))
    every = F.timestamp_seconds(F.unix_seconds(now) + F.coalesce(F.nullif("every_hours", F.lit(0)), F.lit(24)) * 3600)
    is_daily = (F.col("cadence") == "DAILY") & (F.coalesce("at", F.lit("")) != "")
    s = schedules.select("id", is_daily.alias("is_daily"), every.alias("every"), daily.alias("next"))
    return s.select("id", F.when(F.col("is_daily"), F.timestamp_micros("next.micros")).otherwise(F.col("every")).alias("due"), F.when(F.col("is_daily") & ~F.col("next.known"), "unknown zone read as UTC").alias("warning"))


def schedule_may_fire(schedules: DataFrame, attempts: DataFrame, now: Column) -> DataFrame:
    """Schedules with `may_fire` (due, and not just tried for this due time) and `wake` (when that will next be so)."""
    tried = attempts.select("id", F.col("due_at").alias("tried_due"), "retry_at", F.lit(True).alias("tried"))
    s = schedules.join(tried, "id", "left")
    same = F.coalesce(F.col("tried"), F.lit(False)) & F.col("tried_due").eqNullSafe(F.col("next_due_at"))
    due = F.col("enabled") & (F.col("next_due_at").isNull() | (F.col("next_due_at") <= now))
    wake = F.coalesce("next_due_at", now)
    return s.select("id", (due & (~same | (now >= F.col("retry_at")))).alias("may_fire"), F.when(F.col("enabled"), F.when(same, F.greatest(wake, "retry_at")).otherwise(wake)).alias("wake"))


def next_wake(schedules: DataFrame, attempts: DataFrame, now: Column) -> DataFrame:
    return schedule_may_fire(schedules, attempts, now).agg(F.min("wake").alias("next_wake"))


def stage_progress(stages: Column) -> Column:
    done = F.size(F.filter(stages, lambda s: s.status.isin("DONE", "SKIPPED")))
    running = F.try_element_at(F.filter(stages, lambda s: s.status == "RUNNING"), F.lit(1))
    return F.struct(done.alias("done"), F.size(stages).alias("total"), running["name"].alias("current"))


def job_note(status: Column, stages: Column, made: Column) -> Column:
    """What to say of a job: that it made nothing, what its running stage does, or where it failed."""
    running = F.try_element_at(F.filter(stages, lambda s: s.status == "RUNNING"), F.lit(1))
    failed = F.try_element_at(F.filter(stages, lambda s: s.status == "FAILED"), F.lit(1))
    over = status.isin("COMPLETED", "FAILED", "CANCELLED")
    return F.when((status == "COMPLETED") & (made == 0), "nothing worth cutting").when(~over & running.isNotNull(), running["name"]).when(failed.isNotNull(), failed["name"])


def call_stats(calls: DataFrame, by: list[str]) -> DataFrame:
    """Calls by outcome (ok, repaired, failed) with rates and mean seconds."""
    n = F.count(F.lit(1))
    ok, repaired, failed = (F.count_if(F.col("outcome") == k) for k in ("ok", "repaired", "failed"))
    return calls.groupBy(*by).agg(n.alias("calls"), ok.alias("ok"), repaired.alias("repaired"), failed.alias("failed"), F.try_divide(ok, n).alias("ok_rate"), F.try_divide(ok + repaired, n).alias("success_rate"), F.avg("seconds").alias("mean_seconds"))


def trend_activity(jobs: DataFrame, clips: DataFrame) -> DataFrame:
    """Per trend: jobs under way, clips to review and approved, and jobs that finished with nothing. Clips are counted
    per job first, so a job's clips don't multiply it."""
    per_job = clips.groupBy("job_id").agg(F.count(F.lit(1)).alias("made"), F.count_if(F.col("review") == "PENDING").alias("pending"), F.count_if(F.col("review") == "APPROVED").alias("approved"))
    j = jobs.join(per_job, jobs.id == per_job.job_id, "left")
    return j.groupBy("trend_id").agg(
        F.count_if(F.col("status").isin("QUEUED", "RUNNING")).alias("running"), F.coalesce(F.sum("pending"), F.lit(0)).alias("to_review"),
        F.coalesce(F.sum("approved"), F.lit(0)).alias("approved"), F.count_if((F.col("status") == "COMPLETED") & F.col("made").isNull()).alias("empty"),
    )


def job_end_notice(jobs: DataFrame, made: DataFrame) -> DataFrame:
    """Notices of finished jobs: failures, publications, and clips or tracks that are ready; nothing where none were made."""
    j = jobs.join(made, "id", "left").withColumn("made", F.coalesce("made", F.lit(0)))
    kind = F.when(F.col("status") == "FAILED", "JOB_FAILED").when((F.col("status") == "COMPLETED") & (F.col("type") == "PUBLISH"), "PUBLISHED").when((F.col("status") == "COMPLETED") & (F.col("made") > 0), "CLIPS_READY")
    title = F.when(F.col("status") == "FAILED", F.concat(F.initcap("type"), F.lit(" failed"))).when(F.col("type") == "PUBLISH", "A clip went out").otherwise(F.format_string("%d ready", F.col("made")))
    return j.select("id", kind.alias("kind"), title.alias("title")).filter("kind IS NOT NULL")


def notice_inbox(notices: DataFrame, users: DataFrame, longest: int = 120) -> DataFrame:
    """Notices per approved user whose switch is on; a repeat under one fold key replaces the one before."""
    to = notices.join(users.filter("approved AND switched_on"), "uid")
    latest = to.groupBy(F.sha2(F.concat_ws("|", "uid", "kind", "fold"), 256).alias("id")).agg(F.max_by(F.struct("uid", "kind", F.substring("title", 1, longest).alias("title"), "at"), F.struct("at", "seq")).alias("n"))
    return latest.select("id", "n.*")


def admin_audience(users: DataFrame) -> DataFrame:
    return users.filter("approved AND role = 'admin'").select("uid")


def preference_scope(preferences: DataFrame, sources: DataFrame) -> DataFrame:
    """Preferences that hold for each source: its own by an equi-join, and those for everything, which are dealt to buckets by
    their ids; every source asks each bucket. So neither side is gathered or broadcast whole."""
    n = int(preferences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = preferences.filter("scope = 'SOURCE'").join(sources, "source_id").select("source_id", "id")
    everywhere = preferences.filter("scope = 'EVERYTHING'").select("id", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("bucket"))
    asked = sources.select("source_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bucket"))
    return own.unionByName(asked.join(everywhere, "bucket").select("source_id", "id"))


def lesson_key(lesson: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(lesson), r"(?U)[^\p{L}\p{N}_\s]", " "), r"(?U)\s+", " "))


def preference_dedupe(proposed: DataFrame, known: DataFrame) -> DataFrame:
    """Proposals whose lesson is new, the first of each."""
    k = proposed.withColumn("key", lesson_key(F.col("lesson"))).join(known.select(lesson_key(F.col("lesson")).alias("key")).distinct(), "key", "left_anti")
    return k.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy("id"))).filter("rn = 1").select("id", "lesson")


def preference_defaults(accepted: DataFrame, settings: tuple[str, ...], by: str = "source_id") -> DataFrame:
    """The latest accepted value of each setting that has one."""
    return accepted.groupBy(by).agg(*(F.max_by(s, F.when(F.col(s).isNotNull(), F.struct("created_at", "id"))).alias(s) for s in settings))


def use_counter(uses: DataFrame) -> DataFrame:
    """Uses per source, once per job however often a job reads it, and the last access."""
    once = uses.groupBy("source_id", "job_id").agg(F.max("at").alias("at"))
    return once.groupBy("source_id").agg(F.count(F.lit(1)).alias("use_count"), F.max("at").alias("last_access"))


def waiting_alerts(jobs: DataFrame, told: DataFrame, now: Column, minutes: int = 10) -> DataFrame:
    """Jobs queued for long that nobody was told of."""
    late = jobs.filter((F.col("status") == "QUEUED") & (F.unix_seconds(now) - F.unix_seconds(F.col("created_at").cast("timestamp")) >= 60 * minutes))
    return late.join(told, "id", "left_anti")


def agent_presence(checks: DataFrame) -> Column:
    """online, offline, checking or unknown, from a check and the report that answers it."""
    answered = F.col("answered_ping").eqNullSafe(F.col("token")) | ~F.col("last_seen").eqNullSafe(F.col("seen_before"))
    return F.when(F.col("token").isNull() | F.col("report_agent").isNull() | (F.col("report_agent") != F.col("agent_id")), "unknown").when(answered, "online").when(F.col("expired"), "offline").otherwise("checking")


def source_dedupe(submissions: DataFrame, sources: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """New submissions, one per key, that no stored source has."""
    w = Window.partitionBy(*keys).orderBy("submitted_at", "id")
    return submissions.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn").join(sources.select(*keys).distinct(), list(keys), "left_anti")


def readable_views(count: Column) -> Column:
    millions = F.regexp_replace(F.format_string("%.1f", F.round(count / 1e6, 1)), r"\.0$", "")
    return F.when(count >= 1_000_000, F.concat(millions, F.lit("M"))).when(count >= 1000, F.concat(F.floor(count / 1000 + 0.5).cast("string"), F.lit("K"))).otherwise(count.cast("string"))


def readable_age(hours: Column) -> Column:
    h = F.greatest(hours, F.lit(0.0))
    r = lambda x: F.floor(x + 0.5).cast("string")
    return F.when(hours.isNull(), None).when(h < 1, "just now").when(h < 24, F.concat(r(h), F.lit("h ago"))).when(h < 14 * 24, F.concat(r(h / 24), F.lit("d ago"))).otherwise(F.concat(r(h / 168), F.lit("w ago")))


def readable_duration(seconds: Column) -> Column:
    s = F.greatest(F.floor(seconds + 0.5), F.lit(0))
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)).otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))


def song_seconds(lyrics: Column, bpm: Column, longest: int = 300, shortest: int = 30, default_bpm: int = 100) -> Column:
    """Two bars a line, four for a wordless intro or outro, eight for any other wordless section, two at the end; rounded
    up to five seconds."""
    sections = F.slice(F.split(F.concat(F.lit("\n"), lyrics), r"\n\["), F.lit(2), F.lit(10_000))
    bars = F.aggregate(sections, F.lit(2.0), lambda acc, s: acc + _section_bars(s))
    seconds = F.ceil(bars * 240.0 / F.coalesce(bpm, F.lit(default_bpm)) / 5) * 5
    return F.greatest(F.lit(shortest), F.least(seconds, F.lit(longest))).cast("int")


def _section_bars(section: Column) -> Column:
    lines = F.size(F.filter(F.slice(F.split(section, "\n"), F.lit(2), F.lit(10_000)), lambda x: F.trim(x) != ""))
    name = F.lower(F.trim(F.substring_index(F.substring_index(section, "]", 1), "-", 1)))
    return F.when(lines > 0, lines * 2.0).when(name.isin("intro", "outro"), 4.0).otherwise(8.0)
