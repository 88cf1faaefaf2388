"""Exact dedup by skew-safe combining, in DataFrame functions only.

Texts are equal when identical after lower-casing A-Z. Three combining stages, each of which groups by the
digest and the whole text, so equal digests alone never merge rows: rows are deduplicated inside their input
partition (the partial aggregate), the survivors merge in salted digest groups, and the salt winners merge
globally. A text with copies in every input partition reaches a merge as one row per partition at most, and
those are spread over the salts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

SALTS = 16


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per document: id_col, keep_id, group_size, kept, text_sha256.

    The row with the largest id of a group stays. Null text counts as empty; null ids rank lowest, and a group
    of null ids keeps its rows' null as keep_id with kept true. Rows that repeat both id and text share one
    verdict and each count in group_size. Other columns are not read. An empty table gives an empty result.
    If two different texts ever shared a SHA-256 digest the query would fail rather than merge them.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        lower_ascii(F.col(text_col)).alias("norm"),
        (F.spark_partition_id() % salts).alias("salt"),
    ).withColumn("digest", F.sha2("norm", 256))
    salted = rows.groupBy("digest", "salt", "norm").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    merged = salted.groupBy("digest", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    groups = (
        merged.groupBy("digest")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))
        .withColumn("n", F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share a digest"))).otherwise(F.col("n")))
        .filter("n > 1")
        .select("digest", "keep_id", "n", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    )
    members = rows.select("id", "digest", "salt").join(groups, ["digest", "salt"], "left")
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return members.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of docs that stay, all columns kept. Ids are taken to be unique; null ids are kept."""
    gone = exact_groups(docs, id_col, text_col, salts).filter("NOT kept").select(F.col(id_col))
    return docs.join(gone, id_col, "left_anti").select(docs.columns)


def query(spark, sf_dir):
    from .common import table

    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (
  SELECT doc_id, sha256(t) AS text_sha256, t FROM (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents) s),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g ON d.t = g.t
"""
