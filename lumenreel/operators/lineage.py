"""Clip versions, retention plans, publication states, and metadata by precedence. Plans only: nothing is deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import in_parts, running


def root() -> Column:
    """A clip's lineage; an old clip without one is its own root."""
    return F.coalesce(F.col("lineage_id"), F.col("id"))


def newest_per_lineage(clips: DataFrame) -> DataFrame:
    w = Window.partitionBy(root()).orderBy(F.desc("version"), "id")
    return clips.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def collectable(clips: DataFrame, today: Column, grace: int) -> DataFrame:
    """Every clip with `reason` (rejected, superseded or null): not the newest, and rejected or superseded long enough."""
    newest = F.row_number().over(Window.partitionBy(root()).orderBy(F.desc("version"), "id")) == 1
    marked = clips.withColumn("newest", newest)
    reason = F.when(F.col("newest"), None).when(F.col("review") == "REJECTED", "rejected").when(F.datediff(today, "superseded_on") >= grace, "superseded")
    return marked.withColumn("reason", reason)


def tidy_report(clips: DataFrame, today: Column, grace: int) -> DataFrame:
    return collectable(clips, today, grace).filter("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("clips"), F.sum(F.col("size_bytes").cast("long")).alias("bytes"))


def review_queue(clips: DataFrame, state: str) -> DataFrame:
    """The newest version per lineage among the clips of a state that nothing supersedes, newest first."""
    return newest_per_lineage(clips.filter((F.col("review") == state) & F.col("superseded_on").isNull())).orderBy(F.desc("created_on"), "id")


def lineage_peers(clips: DataFrame, touched: DataFrame) -> DataFrame:
    roots = touched.select(root().alias("root")).distinct()
    return clips.withColumn("root", root()).join(roots, "root", "left_semi")


def settled_clips(clips: DataFrame) -> DataFrame:
    return clips.filter((F.col("review") == "REJECTED") | F.col("superseded_on").isNotNull())


def lineage_settlement(clips: DataFrame, decisions: DataFrame) -> DataFrame:
    """The newest decision of a lineage spread to its other versions: rejected with it, or superseded by an approval."""
    d = decisions.groupBy("root").agg(F.max_by(F.struct("id", "decision", "decided_on"), F.struct("decided_on", "id")).alias("d"))
    joined = clips.withColumn("root", root()).join(d, "root").filter("id <> d.id AND d.decision IN ('REJECTED', 'APPROVED')")
    return joined.select(
        "id", F.when(F.col("d.decision") == "REJECTED", "REJECTED").otherwise(F.col("review")).alias("review"),
        F.when(F.col("d.decision") == "APPROVED", F.col("d.decided_on")).otherwise(F.col("superseded_on")).alias("superseded_on"),
    )


def evict_to_target(files: DataFrame, need: Column, by: str = "workspace") -> DataFrame:
    """Files to free, least recently used first, until the bytes needed are reached; pinned and used ones stay."""
    parts = in_parts(files.filter("NOT pinned AND NOT in_use"), [by], ["last_access", "path"])
    totals = parts.groupBy(F.col(by).alias("__by")).agg(F.sum("size_bytes").alias("__total"))
    rows = running(parts, [by], ["last_access", "path"], __before=("sum", F.col("size_bytes"))).filter(F.coalesce("__before", F.lit(0)) < need)
    met = rows.join(totals, F.col(by).eqNullSafe(F.col("__by")))
    return met.withColumn("target_met", F.col("__total") >= need).select(*files.columns, "target_met")


def orphan_files(files: DataFrame, tracks: DataFrame, now: Column, suffixes: tuple[str, ...], min_age_s: int = 3600) -> DataFrame:
    """Files of given suffixes, old enough, that no track names; none at all when there are no tracks."""
    old = files.filter((F.unix_seconds(now) - F.unix_seconds("modified") >= min_age_s) & F.lower(F.substring_index("path", ".", -1)).isin(*suffixes))
    named = referenced_paths(tracks)
    any_track = tracks.limit(1).select(F.lit(True).alias("any"))
    return old.join(F.broadcast(any_track)).drop("any").join(named, "path", "left_anti")


def referenced_paths(tracks: DataFrame) -> DataFrame:
    return tracks.select(F.explode(F.array_compact(F.array("audio", "wide", "tall"))).alias("path")).distinct()


def publish_state(clips: DataFrame, publications: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """One state per clip: PUBLISHED, UPLOADING, SCHEDULED, QUEUED, FAILED or READY; the newest row of a class counts."""
    p = publications.groupBy("clip_id").agg(F.count_if(F.col("state") == "PUBLISHED").alias("published"), F.count_if(F.col("state").isin("PENDING", "UPLOADING")).alias("uploading"), F.count_if(F.col("state") == "FAILED").alias("failed"))
    live = jobs.filter(F.col("status").isin("QUEUED", "RUNNING")).groupBy("clip_id").agg(F.max_by(F.struct("status", "not_before"), F.struct("created_at", "id")).alias("job"))
    state = (
        F.when(F.col("published") > 0, "PUBLISHED").when(F.col("uploading") > 0, "UPLOADING").when(F.col("job.status") == "RUNNING", "UPLOADING")
        .when(F.col("job.not_before") > now, "SCHEDULED").when(F.col("job").isNotNull(), "QUEUED").when(F.col("failed") > 0, "FAILED").otherwise("READY")
    )
    return clips.select("clip_id").join(p, "clip_id", "left").join(live, "clip_id", "left").select("clip_id", state.alias("state"))


def live_attempt(publications: DataFrame) -> DataFrame:
    """The first attempt of a clip on a platform that hasn't failed; of attempts made at one time the one with the lowest id."""
    w = Window.partitionBy("clip_id", "platform").orderBy("created_at", "publication_id")
    return publications.filter(F.col("state").isin("PENDING", "UPLOADING", "PUBLISHED")).withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def publish_gate(review: Column, enabled: Column) -> Column:
    return F.when(~enabled, "PUBLISHING_DISABLED").when(review.isNotNull() & (review != "APPROVED"), "NOT_APPROVED")


def first_text(*values: Column) -> Column:
    """The first value that isn't blank."""
    return F.coalesce(*(F.nullif(F.trim(v), F.lit("")) for v in values))


def layered_metadata(clips: DataFrame) -> DataFrame:
    """Title, description, privacy and tags from publish options, the clip, the channel's defaults, then constants. Blank
    text falls through; an empty tag list that was chosen does not."""
    tags = F.coalesce("option_tags", F.when(F.size("clip_tags") > 0, F.col("clip_tags")), "channel_tags", F.array().cast("array<string>"))
    return clips.select(
        "clip_id", F.concat(first_text(F.col("option_title"), F.col("clip_title"), F.lit("Untitled")), F.coalesce("title_suffix", F.lit(""))).alias("title"),
        F.coalesce(first_text(F.col("option_description"), F.col("clip_description")), F.lit("")).alias("description"),
        first_text(F.col("option_privacy"), F.col("channel_privacy"), F.lit("private")).alias("privacy"),
        F.slice(F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t != ""), 1, 30).alias("tags"),
    )


def parent_window(clips: DataFrame, candidates: DataFrame) -> DataFrame:
    """A clip's own cut: its remake's if there is one, else its candidate's."""
    c = candidates.select(F.col("id").alias("candidate_id"), F.col("start_sec").alias("c0"), F.col("end_sec").alias("c1"))
    return clips.join(c, "candidate_id", "left").select("clip_id", F.coalesce("remake_start", "c0").alias("start_sec"), F.coalesce("remake_end", "c1").alias("end_sec"))


def default_channel(channels: DataFrame, by: str = "uid") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc("is_default"), "position", "id")
    return channels.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def split_plan(ranges: DataFrame, reach: float = 30.0, least: float = 1.0, most: int = 20) -> DataFrame:
    """Parts in order with index and count, or the reason a clip's ranges are refused.

    ranges: clip_id, clip_sec, start_sec, end_sec. Edges within 0.05 s of the clip's own are moved to them.
    """
    c = F.col("clip_sec")
    snap = lambda x: F.when(F.abs(x) < 0.05, 0.0).when(F.abs(x - c) < 0.05, c).otherwise(x)
    w = Window.partitionBy("clip_id")
    rows = ranges.withColumn("start_sec", snap(F.col("start_sec"))).withColumn("end_sec", snap(F.col("end_sec"))).withColumn("n", F.count(F.lit(1)).over(w))
    bad = (
        F.when(F.col("n") > most, "too many parts").when(F.col("end_sec") - F.col("start_sec") < least, "too short")
        .when(F.col("start_sec") < -reach, "starts too early").when(F.col("end_sec") > c + reach, "ends too late")
    )
    rows = rows.withColumn("reason", F.min(bad).over(w))
    order = Window.partitionBy("clip_id").orderBy("start_sec", "end_sec")
    return rows.select(
        "clip_id", F.row_number().over(order).alias("part"), F.col("n").alias("parts"), "start_sec", "end_sec", "reason",
        F.least(F.lit(0.0), F.min("start_sec").over(w)).alias("start_delta"), F.greatest(F.lit(0.0), F.max("end_sec").over(w) - c).alias("end_delta"),
    )
