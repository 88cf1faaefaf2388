"""Change delivery: the whole matching set of a query, handed over only when it has changed.

A stream of document changes is folded into the newest version of each document, and every matching set has a digest that
doesn't depend on order: the count and the wrapping sum of its rows' hashes. Tables are written by batch id, so a batch that
is tried again finds what it wrote, and a set whose digest is the one delivered last isn't delivered again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.contract import read_contract


def digests(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """group, n and digest of each group's rows, whatever their order."""
    h = [F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)]
    sums = [F.sum(x.cast("decimal(38,0)")).cast("string") for x in h]
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.concat_ws(":", *sums).alias("digest"))


def stored(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A table that may not be there yet."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


class LiveQuery:
    """Delivers the set of documents that match, group by group; a function for foreachBatch.

    Documents are JSON texts in the column `value` under `declared`, with an id, a version that rises with each change, and what else
    the query asks; matches says which are in a set, and group in which. What can't be read is in the table rejects and doesn't
    stop the rest: the document's last readable version stays. A document that matches no longer leaves its set, and one that
    moves changes two. A set that has become empty is in `changed` with n = 0. The folder has the tables changes, changed (group, n,
    digest), rejects, delivered, touched (groups of changed documents) and held (their sets), a partition per batch; every `compact` batches changes and changed begin with a fold of all before.
    """

    def __init__(self, path: str, declared: StructType, required: tuple[str, ...], matches: Column, group: str, key: str = "id", version: str = "version", compact: int = 20):
        self.path, self.declared, self.required, self.matches = path, declared, required, matches
        self.group, self.key, self.version, self.compact = group, key, version, compact
        self.columns = [f.name for f in declared.fields]
        self.digests = f"{group} {declared[group].dataType.simpleString()}, n long, digest string, at_batch long"

    def _newest(self, rows: DataFrame) -> DataFrame:
        """The newest version of each document; of equal versions one that doesn't depend on order."""
        rest = [c for c in self.columns if c != self.key]
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), F.struct(self.version, F.xxhash64(*self.columns))).alias("d")).select(self.key, "d.*").select(self.columns)

    def _latest(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(self.group).agg(F.max_by(F.struct("n", "digest", "at_batch"), "at_batch").alias("d")).select(self.group, "d.*")

    def _before(self, spark: SparkSession, kind: str, schema, base: int, batch_id: int) -> DataFrame:
        """All of a table from a base on up to a batch, that one left out."""
        rows = stored(spark, f"{self.path}/{kind}-base/batch={base}", schema)
        for b in range(base, batch_id):
            rows = rows.unionByName(stored(spark, f"{self.path}/{kind}/batch={b}", schema))
        return rows

    def state(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """The newest version of every document before a batch."""
        return self._newest(self._before(spark, "changes", self.declared, batch_id - batch_id % self.compact, batch_id))

    def delivered(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """What each set was when it was last delivered before a batch."""
        return self._latest(self._before(spark, "changed", self.digests, batch_id - batch_id % self.compact, batch_id))

    def _write(self, rows: DataFrame, kind: str, batch_id: int, schema=None) -> DataFrame:
        path = f"{self.path}/{kind}/batch={batch_id}"
        rows.write.mode("overwrite").parquet(path)
        return rows.sparkSession.read.schema(schema or rows.schema).parquet(path)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id and batch_id % self.compact == 0:
            base = batch_id - self.compact
            self._write(self._newest(self._before(spark, "changes", self.declared, base, batch_id)), "changes-base", batch_id)
            self._write(self._latest(self._before(spark, "changed", self.digests, base, batch_id)), "changed-base", batch_id)
        rows, rejects = read_contract(batch, self.declared, self.required)
        self._write(rejects, "rejects", batch_id)
        changes = self._write(self._newest(rows), "changes", batch_id)
        old = self.state(spark, batch_id)
        new = self._newest(old.unionByName(changes))
        touched = old.join(changes.select(self.key), self.key, "left_semi").select(self.group).unionByName(changes.select(self.group)).filter(F.col(self.group).isNotNull()).distinct()
        touched = self._write(touched, "touched", batch_id)  # these two are read several times
        held = self._write(new.filter(self.matches).join(touched, self.group, "left_semi").select(self.columns), "held", batch_id, self.declared)
        now = touched.join(digests(held, self.group, self.columns), self.group, "left").select(self.group, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("digest", F.lit("")).alias("digest"))
        told = self.delivered(spark, batch_id).select(self.group, F.col("digest").alias("__told"))
        other = F.coalesce("__told", F.lit("")) != F.col("digest")
        changed = now.join(told, self.group, "left").filter(other).select(self.group, "n", "digest", F.lit(batch_id).cast("long").alias("at_batch"))
        changed = self._write(changed, "changed", batch_id)
        self.hand_over(held.join(changed.select(self.group), self.group, "left_semi").select(self.columns), changed, batch_id)

    def hand_over(self, rows: DataFrame, changed: DataFrame, batch_id: int) -> None:
        """The sets that changed, whole, as a partition of the table delivered. A sink in this method's place must take a batch that
        it has had as done."""
        self._write(rows, "delivered", batch_id)


def stream_live_query(documents: DataFrame, query: LiveQuery, checkpoint: str):
    """Runs a live query over a stream of documents as far as there are any."""
    return documents.writeStream.foreachBatch(query).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
