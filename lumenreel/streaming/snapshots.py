"""Daily metric rows as a base and what came since, merged when read.

A batch is a delta of its own. Days that are at most `revision` days older than the newest can still be restated; compaction folds
the deltas into those days' partitions alone and lists each day's folder in a manifest. What comes for an older day later is
kept beside it, so the files of a settled day are never opened for a write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .deliver import stored

REVISION_DAYS = 3
MANIFEST = "day date, folder long, upto long, newest date"


class SnapshotStore:
    """Rows by publication_id and day (a date) with partial and any other columns; `schema` names them all.

    A row that is settled (not partial, or null) is final: of settled rows the one of the first batch counts, else that of the last;
    inside a batch the row with the highest seq. So any number of batches and compactions reads as upsert_unsettled batch by batch.
    """

    def __init__(self, path: str, schema: str, keys: tuple[str, ...] = ("publication_id", "day"), revision: int = REVISION_DAYS):
        self.path, self.keys, self.revision = path, keys, revision
        self.schema = f"{schema}, batch long"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """Writes a batch as its delta; a batch that is tried again writes it again."""
        w = Window.partitionBy(*self.keys).orderBy(F.desc("seq"))
        last = batch.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn", "seq")
        last.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{self.path}/deltas/upto={batch_id}")

    def _fold(self, rows: DataFrame) -> DataFrame:
        columns = rows.columns
        settled = ~F.coalesce("partial", F.lit(False))
        order = F.struct(settled.alias("settled"), F.when(settled, -F.col("batch")).otherwise(F.col("batch")).alias("batch"))
        rest = [c for c in columns if c not in self.keys]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), order).alias("row")).select(*self.keys, "row.*").select(columns)

    def manifest(self, spark: SparkSession) -> tuple[int, int, dict]:
        """The last compaction's number, the batch it went up to, and each day's folder. A row per day goes to the driver."""
        names = [n for n in self._names(spark, f"{self.path}/manifest") if n.startswith("v")]
        complete = [int(n[1:]) for n in names if "_SUCCESS" in self._names(spark, f"{self.path}/manifest/{n}")]
        if not complete:
            return 0, -1, {}
        version = max(complete)
        rows = spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/v{version}").collect()
        return version, max((r.upto for r in rows), default=-1), {r.day: r.folder for r in rows if r.day}

    def _names(self, spark: SparkSession, path: str) -> list[str]:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in system.listStatus(where)] if system.exists(where) else []

    def _deltas(self, spark: SparkSession, after: int) -> tuple[DataFrame, int]:
        """Batches after one, and the last of them."""
        batches = sorted(int(n.split("=")[1]) for n in self._names(spark, f"{self.path}/deltas") if n.startswith("upto="))
        some = [b for b in batches if b > after and "_SUCCESS" in self._names(spark, f"{self.path}/deltas/upto={b}")]
        rows = spark.read.schema(self.schema).parquet(*(f"{self.path}/deltas/upto={b}" for b in some)) if some else spark.createDataFrame([], self.schema)
        return rows, max(some, default=after)

    def _base(self, spark: SparkSession, folders: dict) -> DataFrame:
        """The base's rows of some days."""
        paths = [f"{self.path}/base/v{folder}/of={day}" for day, folder in sorted(folders.items())]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def compact(self, spark: SparkSession) -> None:
        """Folds the deltas into the days that may still change, and lists where each day is. Reads and writes no other day."""
        version, upto, folders = self.manifest(spark)
        deltas, last = self._deltas(spark, upto)
        if last == upto:
            return
        newest = deltas.agg(F.max("day")).first()[0]
        newest = max([d for d in (newest, *folders) if d is not None], default=None)
        open_from = None if newest is None else F.date_sub(F.lit(newest), self.revision)
        new = version + 1
        # a day that is older and has no folder yet gets one; one that has is closed
        closed = [d for d in folders if newest is not None and (newest - d).days > self.revision]
        late = F.col("day").isin(closed) if closed else F.lit(False)
        deltas.filter(late).write.mode("overwrite").parquet(f"{self.path}/late/v{new}")
        still = {d: f for d, f in folders.items() if d not in closed}
        rows = self._fold(self._base(spark, still).unionByName(deltas.filter(~late)))
        rows.withColumn("of", F.col("day")).repartition("of").write.mode("overwrite").partitionBy("of").parquet(f"{self.path}/base/v{new}")
        days = {d: folders[d] for d in closed} | {r.day: new for r in spark.read.schema(self.schema).parquet(f"{self.path}/base/v{new}").select("day").distinct().collect()}
        listed = [(d, f, last, newest) for d, f in days.items()] or [(None, None, last, newest)]
        spark.createDataFrame(listed, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v{new}")

    def read(self, spark: SparkSession) -> DataFrame:
        """The rows as they stand: the base, what came late for closed days, and the deltas since."""
        version, upto, folders = self.manifest(spark)
        deltas, _ = self._deltas(spark, upto)
        late = [f"{self.path}/late/v{v}" for v in range(1, version + 1)]
        rows = self._base(spark, folders).unionByName(deltas)
        rows = rows.unionByName(spark.read.schema(self.schema).parquet(*late)) if late else rows
        return self._fold(rows).drop("batch")
