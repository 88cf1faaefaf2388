"""Shared helpers: reading tables, cutting lineage in the shared folder, the held-out split."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the text contracts: space and \x09-\x0D. bytes.split() splits on the same six.
SEPARATORS = "\\x20\\x09-\\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, whatever folder the driver runs in."""
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a session of one machine gets
    a folder of its own, and any other session an error, since its executors don't see each other's folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again, so that what follows starts from a table."""
    path = f"{shared_folder(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_join(many: DataFrame, few: DataFrame, keys: list[str], weight: str, by: list[str]) -> DataFrame:
    """Inner join of many with few, which has each key once and in `weight` how many rows of many have it.

    A key with more rows than a shuffle partition's even share is split: its row of few is repeated, and by the columns
    `by` its rows in many are dealt to the repetitions, so that none gets more than a share. At most one key for each
    partition can be so large; the driver gets those keys' hashes and puts them into both sides' plans. few is read
    several times and should be a table.
    """
    n = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = few.agg(F.sum(weight)).first()[0] or 0
    share = max(1, total // n)
    key = F.xxhash64(*keys)
    hot = few.filter(F.col(weight) > share).select(key.alias("key"), F.col(weight).alias("rows")).collect()
    sizes: dict[int, list[int]] = {}
    for row in hot:
        sizes.setdefault(1 << (-(-row["rows"] // share) - 1).bit_length(), []).append(row["key"])
    parts = F.lit(1)
    for size, hashes in sizes.items():
        parts = F.when(key.isin(hashes), size).otherwise(parts)
    dealt = many.withColumn("__part", F.pmod(F.hash(*by), parts))
    copies = F.explode(F.sequence(F.lit(0), parts - 1))
    return dealt.join(few.withColumn("__part", copies), [*keys, "__part"]).drop("__part")


def apart(keep: tuple[str, ...], *results: str) -> tuple[str, ...]:
    """The columns of keep that don't have a result's name, upper or lower case; those give way to the results."""
    taken = {name.lower() for name in results}
    return tuple(name for name in keep if name.lower() not in taken)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def held_out(doc_id: Column) -> Column:
    """True for the quarter of documents whose crc32(doc_id as text) mod 4 is 2; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@cache
def _trim() -> Callable[[int], int]:
    """What gives free memory back to the system, where the C library has it."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda spare: 0)


def releasing(run: Callable, forget: Callable[[], None] = lambda: None) -> Callable:
    """An Arrow function that at the end of its task forgets what it has remembered and gives free memory back, since the next
    task, of any stage, finds the same Python process."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            forget()
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return released


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096, weight: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Row tuples as Arrow batches of at most `size` rows, or fewer once strings reach `weight` bytes."""
    held: list[tuple] = []
    load = 0
    for row in rows:
        held.append(row)
        load += sum(len(v) for v in row if isinstance(v, (str, bytes, list)))
        if len(held) >= size or load >= weight:
            yield _batch(held, schema)
            held, load = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
