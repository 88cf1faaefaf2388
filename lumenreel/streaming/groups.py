"""Log groups as a stream whose state starts from stored groups, and which keeps the newest occurrences of each."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as T

KEEP = 25
GROUP = "count long, first_us long, last_us long, message string, stack string, status string"
OCCURRENCE = "us long, event_id long"
OUT = f"fingerprint string, {GROUP}, is_new boolean, reopened boolean, kept array<struct<us:long,event_id:long>>"


class LogGroups(StatefulProcessor):
    """A group's counts, times, last message and stack, whether it is open, and its newest occurrences."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.group = handle.getValueState("group", GROUP)
        self.kept = handle.getListState("kept", OCCURRENCE)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """The stored group, and one row for each occurrence that is stored with it."""
        for row in initialState.itertuples(index=False):
            self.group.update((int(row.count_), int(row.first_us), int(row.last_us), row.message, row.stack, row.status))
            self.kept.put([(int(o["us"]), int(o["event_id"])) for o in row.kept][-self.keep :])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.group.exists()
        count, first, last, message, stack, status = self.group.get() if known else (0, None, None, None, None, None)
        kept = [tuple(o) for o in self.kept.get()] if known else []
        reopened, resolved, seen = False, False, 0
        for frame in rows:
            resolved |= bool((frame["kind"] == "resolve").any())
            records = frame[frame["kind"] == "record"].sort_values(["us", "event_id"])
            if not len(records):
                continue
            seen += len(records)
            kept = sorted(kept + list(zip(records["us"].tolist(), records["event_id"].tolist(), strict=True)))[-self.keep :]
            begin, end = int(records["us"].iloc[0]), int(records["us"].iloc[-1])
            first = begin if first is None else min(first, begin)
            if last is None or end >= last:
                last, message = end, records["message"].iloc[-1]
            stacks = records["stack"].dropna()
            stack = stacks.iloc[-1] if len(stacks) else stack
        if resolved and known:
            status = "RESOLVED"
        if seen:
            reopened, status = status == "RESOLVED", "OPEN"
        if count + seen == 0:
            return iter(())
        count += seen
        self.group.update((count, first, last, message, stack, status))
        self.kept.put(kept)
        row = [(key[0], count, first, last, message, stack, status, not known, reopened, [{"us": us, "event_id": i} for us, i in kept])]
        return iter([pd.DataFrame(row, columns=["fingerprint", "count", "first_us", "last_us", "message", "stack", "status", "is_new", "reopened", "kept"])])

    def close(self) -> None:
        pass


def stored_groups(groups: DataFrame, occurrences: DataFrame, keep: int = KEEP) -> DataFrame:
    """Groups as merge_groups gives them and the occurrences that keep_last_n has kept of them, as state to start from."""
    newest = occurrences.groupBy("fingerprint").agg(F.sort_array(F.collect_list(F.struct(F.unix_micros("ts").alias("us"), "event_id"))).alias("kept"))
    none = F.array().cast("array<struct<us:long,event_id:long>>")
    return groups.join(newest, "fingerprint", "left").select(
        "fingerprint", F.col("count").alias("count_"), F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"),
        "message", "stack", "status", F.coalesce("kept", none).alias("kept"),
    )


def stream_log_groups(records: DataFrame, resolutions: DataFrame | None = None, stored: DataFrame | None = None, keep: int = KEEP) -> DataFrame:
    """Each group that a batch changes, whole: what merge_groups over the batches gives, is_new, reopened, and kept, its newest
    `keep` occurrences (microseconds and event id, oldest first), as keep_last_n over their union gives.

    records has level, app, message, stack, ts and event_id; resolutions has fingerprint, and resolves a group as of its batch:
    records of that batch and later ones open it again. stored, from stored_groups, is what groups start from; a stored group without new
    records gives no row. A null stack leaves the last one, and a message counts if nothing later came before it.
    """
    keyed = records.select(
        T.log_fingerprint(F.col("level"), F.col("app"), F.col("message"), F.col("stack")).alias("fingerprint"), F.lit("record").alias("kind"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").cast("long").alias("event_id"), "message", "stack",
    )
    if resolutions is not None:
        none = (F.lit(-1).cast("long").alias("us"), F.lit(-1).cast("long").alias("event_id"), F.lit(None).cast("string").alias("message"), F.lit(None).cast("string").alias("stack"))
        keyed = keyed.unionByName(resolutions.select("fingerprint", F.lit("resolve").alias("kind"), *none))
    start = stored.groupBy("fingerprint") if stored is not None else None
    return keyed.groupBy("fingerprint").transformWithStateInPandas(LogGroups(keep), OUT, "Update", "None", start)
