"""Reading documents under a fixed schema: unknown fields go, missing or mistyped ones are rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

CORRUPT = "_corrupt_record"


def field_paths(schema: DataType, prefix: str = "") -> set[str]:
    """Dotted paths of all fields, through structs and arrays of structs."""
    if isinstance(schema, ArrayType):
        return field_paths(schema.elementType, prefix)
    if not isinstance(schema, StructType):
        return set()
    found: set[str] = set()
    for field in schema.fields:
        found |= {prefix + field.name} | field_paths(field.dataType, f"{prefix}{field.name}.")
    return found


def unknown_fields(documents: DataFrame, declared: StructType, column: str = "value") -> DataFrame:
    """Paths that documents have and the schema doesn't, each once, with how many documents have it."""
    keys = documents.select(F.explode(F.json_object_keys(column)).alias("path"))
    known = [f.name for f in declared.fields]
    return keys.filter(~F.col("path").isin(*known)).groupBy("path").agg(F.count(F.lit(1)).alias("documents"))


def read_contract(documents: DataFrame, declared: StructType, required: tuple[str, ...], column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a column of JSON documents.

    Only declared fields are kept, at every depth. A document that isn't JSON of the declared types, or lacks a
    required field, is in rejects with its text and a reason. Null documents are rejected.
    """
    schema = StructType([*declared.fields, StructField(CORRUPT, StringType())])
    parsed = documents.select(F.col(column).alias("__text"), F.from_json(column, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("d"))
    missing = F.array_compact(F.array(*(F.when(F.col(f"d.{name}").isNull(), F.lit(name)) for name in required)))
    reason = F.when(F.col("d").isNull() | F.col(f"d.{CORRUPT}").isNotNull(), "not of the declared types").when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))
    marked = parsed.withColumn("reason", reason)
    rows = marked.filter("reason IS NULL").select(*(f"d.{f.name}" for f in declared.fields))
    return rows, marked.filter("reason IS NOT NULL").select(F.col("__text").alias(column), "reason")


def drop_nested_paths(document: Column, paths: list[str]) -> Column:
    """A struct without some dotted paths; arrays aren't entered."""
    return document.dropFields(*paths) if paths else document


def _judged(documents: DataFrame, declared: StructType, required: tuple[str, ...], ranges: dict[str, tuple[float, float]], column: str) -> DataFrame:
    """documents with __d, what they say under the contract, and __reason, why they aren't accepted; null where they are."""
    schema = StructType([*declared.fields, StructField(CORRUPT, StringType())])
    parsed = documents.withColumn("__d", F.from_json(column, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    missing = F.array_compact(F.array(*(F.when(F.col(f"__d.{name}").isNull(), F.lit(name)) for name in required)))
    out = F.array_compact(F.array(*(F.when(~F.col(f"__d.{k}").between(low, high), F.lit(k)) for k, (low, high) in ranges.items())))
    reason = (
        F.when(F.col("__d").isNull() | F.col(f"__d.{CORRUPT}").isNotNull(), "not of the declared types")
        .when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))
        .when(F.size(out) > 0, F.concat(F.lit("out of range: "), F.array_join(out, ", ")))
    )
    return parsed.withColumn("__reason", reason)


def structured_response(responses: DataFrame, declared: StructType, required: tuple[str, ...], ranges: dict[str, tuple[float, float]], column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) model answers: a contract, and bounds on numbers."""
    judged = _judged(responses.select(column), declared, required, ranges, column)
    return judged.filter("__reason IS NULL").select(*(f"__d.{f.name}" for f in declared.fields)), judged.filter("__reason IS NOT NULL").select(column, F.col("__reason").alias("reason"))


def repaired_responses(
    responses: DataFrame, declared: StructType, required: tuple[str, ...], ranges: dict[str, tuple[float, float]], repair, key: str = "id", column: str = "value"
) -> DataFrame:
    """Every answer judged, and those that fail repaired once: key, the declared fields (null where it failed), outcome (ok,
    repaired or failed), attempts (1 or 2) and reason (what was wrong with the first answer, or with the second if that failed).

    repair is the user's: pandas frames (key, value, reason) to frames (key, value), run by tasks over the rejects alone; a key that it doesn't
    answer has failed, and of several answers the least counts. What it gives is written before it is judged, so it isn't asked twice for
    one answer; a repair that fails isn't tried again. Keys are unique.
    """
    from ..operators.selection import cut

    fields = [f.name for f in declared.fields]
    first = cut(_judged(responses.select(key, column), declared, required, ranges, column).withColumn("__d", F.struct(*(F.col(f"__d.{n}").alias(n) for n in fields))))
    good = first.filter("__reason IS NULL").select(key, *(f"__d.{n}" for n in fields), F.lit("ok").alias("outcome"), F.lit(1).alias("attempts"), F.lit(None).cast("string").alias("reason"))
    bad = first.filter("__reason IS NOT NULL").select(key, column, F.col("__reason").alias("reason"))
    again = bad.mapInPandas(repair, responses.select(key, column).schema)
    second = _judged(cut(again).groupBy(key).agg(F.min(column).alias(column)), declared, required, ranges, column)
    fixed = F.col("__answered") & F.col("__reason").isNull()
    joined = bad.select(key, "reason").join(second.select(key, "__d", "__reason", F.lit(True).alias("__answered")), key, "left").withColumn("__answered", F.coalesce("__answered", F.lit(False)))
    rest = joined.select(
        key, *(F.when(fixed, F.col(f"__d.{n}")).alias(n) for n in fields), F.when(fixed, "repaired").otherwise("failed").alias("outcome"), F.lit(2).alias("attempts"),
        F.when(~fixed, F.coalesce("__reason", F.concat("reason", F.lit(", no repair")))).otherwise(F.col("reason")).alias("reason"),
    )
    return good.unionByName(rest)


def read_json(spark: SparkSession, path: str, declared: StructType) -> DataFrame:
    return spark.read.schema(declared).option("mode", "PERMISSIVE").json(path)
