"""SimHash near-dedup by multi-index hashing.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most one bit in one of their two 32-bit
halves. Each half has a table of fingerprints keyed by the half; every fingerprint is looked up in it at its own
half and at all halves one bit away, and the matches' complete distance is verified. Since every fingerprint is
looked up, flipping set bits alone finds each pair from one of its sides.

Where many fingerprints share a half, pairs would grow with the square of the bucket. Such a bucket is linked
exactly through points of the other half instead: two members at most 3 bits apart have a point one bit or less
from one and two bits or less from the other, so every fingerprint emits the points around it, and the smallest
member next to a point is linked with all that reach the point. That is linear in the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, cut, releasing, spread_join, table

SEED, SHINGLE, BITS, HALF = 42, 3, 3, 32
#: A looked-up half with more pairs than this many for each row in it is linked through points.
PAIRS = 300


def simhash_text(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text's word shingles as a signed 64-bit integer; without words it is 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    hashed = xxhash.xxh64_intdigest
    found = np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts.tolist(), last.tolist(), strict=False)), np.uint64, n)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        block = found[at : at + 65536]
        set_bits += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > n, bitorder="little").tobytes(), "little", signed=True)


def simhash(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named in keep and fp (long): the fingerprint of every whole text; null counts as empty. A column of
    keep that is named like a result gives way to it."""
    keep = apart(keep, "fp")
    schema = docs.select(*keep).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [simhash_text(t.as_py(), shingle) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps, pa.int64())], [*keep, "fp"])

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(releasing(run), schema)


def _half(fp: Column, which: int) -> Column:
    return F.shiftrightunsigned(fp, HALF) if which else fp.bitwiseAND(F.lit((1 << HALF) - 1))


def _lower_neighbours(half: Column) -> Column:
    """All values one set bit below a half."""
    ones = F.filter(F.array(*(F.lit(1 << b) for b in range(HALF))), lambda mask: half.bitwiseAND(mask) != 0)
    return F.transform(ones, lambda mask: half.bitwiseXOR(mask))


def fingerprint_links(fps: DataFrame, bits: int = BITS, pairs: int = PAIRS) -> DataFrame:
    """Links (a, b) between distinct fingerprints: every link's ends differ in at most `bits` (3 or fewer) bits,
    and two fingerprints that do so are linked directly or through others of the result. fps has one column fp."""
    fps = fps.select("fp").distinct()
    tables, probes = [], []
    for which in (0, 1):
        half = _half(F.col("fp"), which)
        tables.append(fps.select(F.lit(which).alias("half"), half.alias("value"), "fp"))
        probes.append(fps.select(F.lit(which).alias("half"), F.explode(_lower_neighbours(half)).alias("value"), "fp"))
    rows = tables[0].unionByName(tables[1]).withColumn("own", F.lit(True))
    rows = rows.unionByName(probes[0].unionByName(probes[1]).withColumn("own", F.lit(False)))
    # A looked-up half matters only if a fingerprint owns it and another row meets it there. Keys with very many rows are
    # dealt to several tasks, crowded halves and those that are one bit from them alike.
    sizes = rows.groupBy("half", "value").agg(F.count_if("own").alias("own_n"), F.count(F.lit(1)).alias("n"))
    sizes = cut(sizes.filter("own_n > 0 AND n > 1").select("half", "value", "n", (F.col("own_n") > pairs).alias("dense")), "simhash-sizes")
    met = cut(spread_join(rows, sizes, ["half", "value"], "n", ["fp"]), "simhash-met")
    sparse, dense = met.filter("NOT dense"), met.filter("dense").drop("n")
    owners = cut(sparse.filter("own").groupBy("half", "value").agg(F.collect_list("fp").alias("others"), F.first("n").alias("n")), "simhash-owners")
    direct = (
        spread_join(sparse.select("half", "value", "own", F.col("fp").alias("a")), owners, ["half", "value"], "n", ["a"])
        .select("own", "a", F.explode("others").alias("b"))
        .filter("(NOT own OR a < b)")
        .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
        .select("a", "b")
    )
    return direct.unionByName(_through_points(dense, bits)).distinct()


def _through_points(dense: DataFrame, bits: int) -> DataFrame:
    near = [0, *(1 << b for b in range(HALF))]
    far = [(1 << a) | (1 << b) for a, b in combinations(range(HALF), 2)] if bits > 2 else []
    masks = F.array(*(F.struct(F.lit(m).cast("long").alias("mask"), F.lit(m.bit_count()).alias("away")) for m in near + far))
    other = F.when(F.col("half") == 0, _half(F.col("fp"), 1)).otherwise(_half(F.col("fp"), 0))
    # away + the flipped bit of the looked-up half + one more bit at most: within `bits`.
    reach = F.lit(bits - 1) - F.when(F.col("own"), 0).otherwise(1)
    points = (
        dense.select("half", "value", "own", "fp", other.alias("other"), F.filter(masks, lambda m: m.away <= reach).alias("masks"))
        .select("half", "value", "own", "fp", "other", F.explode("masks").alias("m"))
        .select("half", "value", F.col("other").bitwiseXOR(F.col("m.mask")).alias("point"), "own", "fp", F.col("m.away").alias("away"))
    )
    hub = points.groupBy("half", "value", "point").agg(F.min(F.when(F.col("own") & (F.col("away") <= 1), F.col("fp"))).alias("a"), F.count(F.lit(1)).alias("n"))
    hub = cut(hub.filter("a IS NOT NULL AND n > 1"), "simhash-hubs")
    met = spread_join(points.select("half", "value", "point", "fp"), hub, ["half", "value", "point"], "n", ["fp"])
    return met.filter("a <> fp").select("a", F.col("fp").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): node, component (its smallest node), by large-star and small-star
    rounds until one changes nothing; each round is written to the shared folder. The links of a node that has very many are
    dealt to several tasks. Nodes without links aren't in the result."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
        large = spread_join(both, least, ["u"], "n", ["v"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = cut(large, "large")
        lows = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "lows")
        joined = spread_join(large, lows, ["u"], "n", ["v"])
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lows.select("u", F.col("m").alias("v")))
        edges = cut(small.filter("u <> v").distinct(), "edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = state


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: id_col, fp (long), component_id (the smallest id of its component).

    Equal fingerprints are always linked; null text counts as empty, and texts without words have fingerprint 0
    and are linked like any other. Null ids never become a component's id unless all its ids are null. Repeated
    rows stay repeated. Copies aren't expanded into pairs: fingerprints are linked, not documents.
    """
    rows = cut(simhash(docs.select(F.col(id_col).alias("id"), text_col), text_col, shingle, ("id",)), "simhash")
    firsts = cut(rows.groupBy("fp").agg(F.min("id").alias("first")), "simhash-firsts")
    groups = components(fingerprint_links(firsts, bits))
    named = firsts.join(groups, firsts.fp == groups.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = named.join(least, "component").select("fp", "component_id")
    salts = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("salt")
    salted = labels.select("fp", "component_id", salts)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(8)).cast("int"))
    return rows.join(salted, ["fp", "salt"]).select(F.col("id").alias(id_col), "fp", "component_id")


def query(spark, sf_dir):
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
