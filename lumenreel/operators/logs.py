"""Log records: groups per fingerprint, newest occurrences, a rolling rate limit, exports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def with_fingerprint(records: DataFrame) -> DataFrame:
    return records.withColumn("fingerprint", T.log_fingerprint(F.col("level"), F.col("app"), F.col("message"), F.col("stack")))


def log_groups(records: DataFrame) -> DataFrame:
    """Per fingerprint: count, first and last seen, the last message, and the last stack that isn't null."""
    return records.groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.max_by("message", F.struct("ts", "event_id")).alias("message"), F.max_by("stack", F.when(F.col("stack").isNotNull(), F.struct("ts", "event_id"))).alias("stack"),
    )


def merge_groups(old: DataFrame, new: DataFrame) -> DataFrame:
    """Groups of a batch merged into the stored ones; a resolved group that occurs again is open again."""
    o = old.select("fingerprint", F.struct("count", "first_seen", "last_seen", "message", "stack", "status").alias("o"))
    n = new.select("fingerprint", F.struct("count", "first_seen", "last_seen", "message", "stack").alias("n"))
    later = F.coalesce(F.col("n.last_seen") >= F.col("o.last_seen"), F.col("n").isNotNull())
    return o.join(n, "fingerprint", "full_outer").select(
        "fingerprint", (F.coalesce("o.count", F.lit(0)) + F.coalesce("n.count", F.lit(0))).alias("count"), F.least("o.first_seen", "n.first_seen").alias("first_seen"),
        F.greatest("o.last_seen", "n.last_seen").alias("last_seen"), F.when(later, F.col("n.message")).otherwise(F.col("o.message")).alias("message"),
        F.coalesce("n.stack", "o.stack").alias("stack"), F.when(F.col("n").isNotNull(), "OPEN").otherwise(F.col("o.status")).alias("status"),
    )


def keep_last_n(records: DataFrame, n: int = 25) -> DataFrame:
    w = Window.partitionBy("fingerprint").orderBy(F.desc("ts"), F.desc("event_id"))
    return records.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).drop("rn")


def rate_limit(records: DataFrame, most: int = 30, seconds: float = 60.0) -> DataFrame:
    """Records that a rolling limit accepts, per app in time order. What is accepted depends on what was accepted, so
    records are taken in order, in batches, and only the last accepted times are held. A pause as long as the span
    forgets all that was before, so an app's record stream is dealt in the parts between such pauses."""
    def run(frames):
        part, held = None, []
        for frame in frames:
            keep = []
            for *now, at in zip(frame["app"], frame["part"], frame["second"], strict=True):
                if now != part:
                    part, held = now, []
                held = [t for t in held if at - t < seconds]
                if len(held) < most:
                    held.append(at)
                    keep.append(True)
                else:
                    keep.append(False)
            yield pd.DataFrame({"event_id": frame.event_id, "app": frame.app, "accepted": keep})

    timed = records.select("event_id", "app", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us")).withColumn("second", F.col("us") / 1e6)
    by_time = Window.partitionBy("app").orderBy("second", "event_id")
    pause = F.coalesce((F.col("second") - F.lag("second").over(by_time) >= seconds).cast("int"), F.lit(0))
    parts = timed.withColumn("pause", pause).withColumn("part", F.sum("pause").over(by_time))
    return parts.repartition("app", "part").sortWithinPartitions("app", "part", "second", "event_id").mapInPandas(run, "event_id long, app string, accepted boolean")


def export_json(groups: DataFrame) -> DataFrame:
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    row = F.struct("fingerprint", "count", iso("first_seen").alias("firstSeen"), iso("last_seen").alias("lastSeen"), "message", "stack")
    return groups.select("fingerprint", F.to_json(row).alias("json"))


def stack_excerpt(stack: Column, most: int = 20) -> Column:
    """The informative end: the tail of a traceback, the head of any other stack."""
    lines = F.split(stack, "\n")
    n = F.size(lines)
    tail = F.slice(lines, F.greatest(n - most + 1, F.lit(1)), F.lit(most))
    return F.array_join(F.when(T.is_traceback(stack), tail).otherwise(F.slice(lines, 1, most)), "\n")


def fence(text: Column) -> Column:
    """Backticks that no run in the text reaches."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), lambda r: F.length(r))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def export_markdown(groups: DataFrame) -> DataFrame:
    body = F.coalesce(stack_excerpt(F.col("stack")), F.lit(""))
    text = F.concat(F.lit("## "), "message", F.format_string("\n\n%d times\n\n", F.col("count")), fence(body), F.lit("\n"), body, F.lit("\n"), fence(body))
    return groups.select("fingerprint", text.alias("markdown"))
