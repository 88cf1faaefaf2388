"""Counts that stay right when rows or batches come again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .deliver import stored


#: Keys of the state; each holds its share of all pairs that are remembered.
BUCKETS = 256
PAIR = np.dtype([("counted", "i8"), ("by", "i8"), ("last", "i8")])


class FirstUse(StatefulProcessor):
    """Whether a pair was seen, until the watermark has passed its last use by `keep_ms`. A key is a bucket of pairs, which are one value
    of its state, sorted, so that a batch's pairs are looked up together."""

    def __init__(self, keep_ms: int):
        self.keep = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pairs = handle.getValueState("pairs", "rows binary")

    def _known(self) -> np.ndarray:
        return np.frombuffer(self.pairs.get()[0], PAIR) if self.pairs.exists() else np.zeros(0, PAIR)

    def _remember(self, known: np.ndarray) -> None:
        """Keeps the pairs, and one timer for the first that will be forgotten."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if len(known):
            self.pairs.update((known.tobytes(),))
            self.handle.registerTimer(int(known["last"].min()) + self.keep)
        else:
            self.pairs.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        used = pd.concat([frame[["counted", "by", "ms"]].groupby(["counted", "by"], as_index=False).max() for frame in rows])
        used = used.groupby(["counted", "by"], as_index=False).max()
        known = self._known()
        before = pd.DataFrame({name: known[name] for name in PAIR.names})
        both = used.merge(before, "outer", ["counted", "by"]).sort_values(["counted", "by"])
        kept = np.empty(len(both), PAIR)
        kept["counted"], kept["by"] = both["counted"], both["by"]
        # a pair is in one of the two at least; times of the other are none
        least = np.iinfo(np.int64).min
        ms, last = (both[c].astype("Int64").fillna(least).to_numpy("int64") for c in ("ms", "last"))
        kept["last"] = np.maximum(ms, last)
        self._remember(kept)
        new = ms > least
        found = {"counted": kept["counted"][new], "by": kept["by"][new], "first": (last[new] == least).astype("int32"), "ms": ms[new]}
        return iter([pd.DataFrame(found)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self._known()
        self._remember(known[known["last"] + self.keep > timerValues.getCurrentWatermarkInMs()])
        return iter(())

    def close(self) -> None:
        pass


def stream_counts(uses: DataFrame, path: str, checkpoint: str, delay: str = "1 day", keep_ms: int = 7 * 86_400_000, buckets: int = BUCKETS):
    """Counts each (counted, by) once, however often it is read and whatever comes again, and the last time of any use.

    uses has counted, by and at. A pair is remembered until its last use lies keep_ms before the watermark, which is `delay` behind the
    newest row. Each batch's counts are a partition of their own that a batch that is tried again writes again; read_counts adds
    them up. Pairs are dealt to `buckets` keys of the state; the number stays with a checkpoint.
    """
    at = F.col("at").cast("timestamp")
    rows = uses.select(F.col("counted").cast("long").alias("counted"), F.col("by").cast("long").alias("by"), at.alias("at"), F.unix_millis(at).alias("ms")).withWatermark("at", delay)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("counted", "by"), F.lit(buckets)).cast("int"))
    firsts = rows.groupBy("bucket").transformWithStateInPandas(FirstUse(keep_ms), "counted long, by long, first int, ms long", "Update", "EventTime")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy("counted").agg(F.sum("first").cast("long").alias("n"), F.max("ms").alias("last_ms")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return firsts.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_counts(spark: SparkSession, path: str, base: DataFrame | None = None) -> DataFrame:
    """counted, n and last_at: what the batches add up to, on top of a base with the same columns."""
    rows = stored(spark, path, "counted long, n long, last_ms long").select("counted", "n", F.timestamp_millis("last_ms").alias("last_at"))
    rows = rows if base is None else rows.unionByName(base.select("counted", "n", "last_at"))
    return rows.groupBy("counted").agg(F.sum("n").alias("n"), F.max("last_at").alias("last_at"))
