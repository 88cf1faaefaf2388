"""Metric history: gap-free daily snapshots, settling, and what is folded from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import is_partial

COUNTERS = ("views", "likes", "comments", "shares")


def published_only(publications: DataFrame) -> DataFrame:
    return publications.filter("state = 'PUBLISHED' AND external_id IS NOT NULL")


def poll_range(publications: DataFrame, window_days: int, today: Column) -> DataFrame:
    """Per publication the days to ask for; one without an external id gets a reason and no range."""
    start = F.least(F.greatest(F.to_date("published_at"), F.date_sub(today, window_days)), today)
    ok = F.col("external_id").isNotNull()
    return publications.select(
        "publication_id", F.when(ok, start).alias("start"), F.when(ok, today).alias("end"), F.when(~ok, "no external id").alias("reason")
    )


def calendar_fill(ranges: DataFrame, daily: DataFrame, today: Column) -> DataFrame:
    """One row per publication and day from start to the earlier of end and today.

    ranges: publication_id, start, end, published_at. Days without a row get zero counters, null averages, and
    are partial; days within the restatement span are partial too. days_since_publish is at least 0.
    """
    last = F.least(F.col("end"), today)
    days = ranges.filter(F.col("start") <= last).select("publication_id", "published_at", F.explode(F.sequence("start", last)).alias("day"))
    found = days.join(daily.withColumn("known", F.lit(True)), ["publication_id", "day"], "left")
    averages = [c for c in daily.columns if c not in ("publication_id", "day", *COUNTERS)]
    return found.select(
        "publication_id", "day",
        *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in COUNTERS),
        *averages,
        (F.col("known").isNull() | is_partial(F.col("day"), today)).alias("partial"),
        F.greatest(F.datediff("day", F.to_date("published_at")), F.lit(0)).alias("days_since_publish"),
    )


def missing_days(ranges: DataFrame, snapshots: DataFrame) -> DataFrame:
    days = ranges.select("publication_id", F.explode(F.sequence("start", "end")).alias("day"))
    return days.join(snapshots.select("publication_id", "day"), ["publication_id", "day"], "left_anti")


def snapshots_since(snapshots: DataFrame, since: Column | None = None) -> DataFrame:
    """A publication's snapshots from a date on; no date means all."""
    return snapshots if since is None else snapshots.filter(F.col("day") >= since)


def upsert_unsettled(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("publication_id", "day")) -> DataFrame:
    """New rows replace partial ones; a settled row is final. `written` marks rows that came from new."""
    rest = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*rest).alias("old"))
    b = new.select(*keys, F.struct(*rest).alias("new"))
    both = a.join(b, list(keys), "full_outer")
    settled = F.col("old").isNotNull() & ~F.coalesce(F.col("old.partial"), F.lit(False))
    keep_old = F.col("new").isNull() | settled
    return both.select(*keys, F.when(keep_old, F.col("old")).otherwise(F.col("new")).alias("row"), (~keep_old).alias("written")).select(
        *keys, "row.*", "written"
    )


def fold_snapshots(snapshots: DataFrame) -> DataFrame:
    """Per publication: counters summed, days, and the latest percentage that is known."""
    pct = F.col("average_view_percentage")
    return snapshots.groupBy("publication_id").agg(
        *(F.sum(c).alias(c) for c in COUNTERS[:3]),
        F.count(F.lit(1)).alias("days"),
        F.max_by(pct, F.when(pct.isNotNull(), F.col("day"))).alias("view_percentage"),
    )


def rollup_publications(snapshots: DataFrame) -> DataFrame:
    """fold_snapshots, most viewed first."""
    return fold_snapshots(snapshots).orderBy(F.desc("views"), "publication_id")


def insight_totals(snapshots: DataFrame) -> DataFrame:
    return snapshots.agg(
        F.sum("views").alias("views"), F.count_distinct("publication_id").alias("publications"), F.count(F.lit(1)).alias("snapshots"),
        F.count_distinct(F.when(F.col("average_view_percentage").isNotNull(), F.col("publication_id"))).alias("drawable"),
    )


def usage_daily(points: DataFrame, today: Column, zone: str, kinds: list[str], days: int = 7) -> DataFrame:
    """The last local days, zero-filled, with a column per kind."""
    local = F.to_date(F.from_utc_timestamp(F.col("at").cast("timestamp"), zone))
    sums = points.select(local.alias("day"), "metric", "value").groupBy("day").pivot("metric", kinds).agg(F.sum("value"))
    spark = points.sparkSession
    calendar = spark.range(1).select(F.explode(F.sequence(F.date_sub(today, days - 1), today)).alias("day"))
    return calendar.join(sums, "day", "left").select("day", *(F.coalesce(F.col(k), F.lit(0)).cast("long").alias(k) for k in kinds))


def quota_ledger(calls: DataFrame, cap: int, cost: int) -> DataFrame:
    """Units per UTC day against a cap, and how many more calls of one cost fit."""
    used = calls.groupBy(F.to_date("at").alias("day")).agg(F.sum("units").alias("used"))
    return used.select("day", "used", F.greatest(F.floor((F.lit(cap) - F.col("used")) / cost), F.lit(0)).alias("uploads_left"))


def quota_refusals(calls: DataFrame, cap: int) -> DataFrame:
    """Calls in order, with the units of their day so far; refused once the cap would be passed."""
    running = F.sum("units").over(Window.partitionBy(F.to_date("at")).orderBy("at", "call_id").rowsBetween(Window.unboundedPreceding, 0))
    return calls.withColumn("running", running).withColumn("refused", F.col("running") > cap)
