"""Latest state, a rolling rate limit, and helpers to run streams; the other streams are in the modules beside this one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


def latest_state(changes: DataFrame, key: str, order: str) -> DataFrame:
    """The last change of each key, deletions left out."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return changes.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1 AND NOT deleted").drop("__rn")


class RateLimit(StatefulProcessor):
    """Accepts at most `most` records per key in any rolling span of seconds; holds accepted times only."""

    def __init__(self, most: int, seconds: float):
        self.most, self.seconds = most, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("accepted", "second double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [t[0] for t in self.times.get()]
        frame = pd.concat(list(rows)).sort_values(["second", "event_id"])
        keep = []
        for second in frame["second"]:
            held = [t for t in held if second - t < self.seconds]
            keep.append(len(held) < self.most)
            if keep[-1]:
                held.append(second)
        self.times.put([(t,) for t in held])
        yield pd.DataFrame({"event_id": frame["event_id"], "app": key[0], "accepted": keep})

    def close(self) -> None:
        pass


def stream_rate_limit(records: DataFrame, most: int = 30, seconds: float = 60.0) -> DataFrame:
    return records.select("app", "event_id", "second").groupBy("app").transformWithStateInPandas(RateLimit(most, seconds), "event_id long, app string, accepted boolean", "Append", "None")


def file_stream(spark, path: str, schema: StructType | str, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def drain(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into an in-memory table (tests and small reports)."""
    spark = df.sparkSession
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
