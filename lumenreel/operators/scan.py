"""Running values over rows in order, without a task that sees all rows of a key.

Rows are range-partitioned by key and order and written; each part of a key is summed up, the parts' sums are run over in order
(a row for each part that a key reaches into), and every row adds to them what its own part has before it. Any associative value
goes that way: here sums, greatest values, and the last value that isn't null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import cut

PART = "__part"


def in_parts(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows as a table with the part that each lies in. Parts follow one another in the order of keys and order; rows that are equal
    in both are in one part."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(n, *keys, *order).withColumn(PART, F.spark_partition_id()))


def running(parts: DataFrame, keys: list[str], order: list[str], **values: tuple[str, Column]) -> DataFrame:
    """parts (from in_parts) with a column for each of values: what a "sum", a "max" or the "last" value that isn't null makes of the
    rows of its keys before it, in order; null where there are none. Null keys are keys like any other."""
    inside = Window.partitionBy(*keys, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    own, whole, past, both = {}, [], [], {}
    for name, (kind, value) in values.items():
        a, b = F.col(f"__own_{name}"), F.col(f"__past_{name}")
        if kind == "last":
            own[f"__own_{name}"] = F.last(value, ignorenulls=True).over(inside)
            whole.append(F.max_by(value, F.when(value.isNotNull(), F.struct(*order))).alias(name))
            past.append(F.last(name, ignorenulls=True).over(before).alias(f"__past_{name}"))
            both[name] = F.coalesce(a, b)
        elif kind in ("sum", "max"):
            fold = F.sum if kind == "sum" else F.max
            own[f"__own_{name}"] = fold(value).over(inside)
            whole.append(fold(value).alias(name))
            past.append(fold(name).over(before).alias(f"__past_{name}"))
            both[name] = F.coalesce(a + b if kind == "sum" else F.greatest(a, b), a, b)
        else:
            raise ValueError(f"{kind} is not one of sum, max and last")
    sums = parts.groupBy(*keys, PART).agg(*whole)
    sums = sums.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col(PART).alias(f"_{PART}"), *past)
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys), F.col(PART) == F.col(f"_{PART}"))
    return parts.withColumns(own).join(sums, same).withColumns(both).select(*parts.columns, *values)
