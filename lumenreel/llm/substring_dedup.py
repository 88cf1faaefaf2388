"""Substring dedup with a compressed FM-index per shard.

A window is `window` consecutive words of one document; a word goes if a window that covers it also starts
anywhere else. Searching every document in every shard's index would cost documents times shards, so shards are
made by content: each window belongs to the smallest hashed run of ANCHOR words inside it, equal windows have
equal anchors, and a document's neighbouring windows with one anchor form a fragment. Fragments whose anchor
occurs once can't repeat. Of equal fragments one stands for all. The rest is sent to shards by anchor; each shard
builds an index over its fragments, streams them through it by backward search, and reports which windows occur
twice. An anchor with very many different fragments would make one shard too large; its fragments are cut finer by
a longer anchor, and again by a longer one where that doesn't do, up to the window itself, whose fragments are all equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, batches_of, cut, releasing, spread_join, table
from .fm_index import FMIndex

WINDOW, ANCHOR = 35, 8
#: Different fragments of one anchor beyond which they are cut finer, by an anchor of so many words more.
CROWD, FINER = 64, 16
#: Words of one index; a larger shard is indexed anchor group by anchor group.
INDEX_WORDS = 1 << 18
#: Fragments, and bytes of unpacked texts, of one Arrow batch; a longer text alone.
ROWS, BYTES = 50_000, 4 << 20
#: What tells fragments apart: their anchor and 128 bits over their words.
KEY = ["anchor", "c1", "c2"]


def _anchored(words: list[bytes], window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fragments of a document: first windows, window counts, and hashes of their anchors of k words."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        run, length, base = h, 1, np.uint64(0x9E3779B97F4A7C15)
        grams = np.zeros(len(h) - k + 1, np.uint64)
        done = 0
        while done < k:  # runs of k words from runs of powers of two
            if (k - done) & length:
                part = run[done : done + len(grams)]
                grams = grams * base ** np.uint64(length) + part
                done += length
            if done < k:
                run, length = run[:-length] * base ** np.uint64(length) + run[length:], length * 2
        grams ^= grams >> np.uint64(31)
        grams *= np.uint64(0xBF58476D1CE4E5B9)
        grams ^= grams >> np.uint64(29)
    least = np.lib.stride_tricks.sliding_window_view(grams, window - k + 1).argmin(axis=1)
    at = least + np.arange(len(least))
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    return first, np.diff(np.append(first, len(at))), grams[at[first]].view(np.int64)


def _contents(pieces) -> tuple[np.ndarray, np.ndarray]:
    """128 bits over each piece, as two columns."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, pieces)), ">i8").reshape(-1, 2).astype(np.int64)
    return both[:, 0], both[:, 1]


_FRAGMENTS = pa.schema([("uid", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("anchor", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64())])


def _fragments(window: int):
    """Rows (uid, packed text) as fragments."""

    def made(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(columns, _FRAGMENTS, strict=True)], schema=_FRAGMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[], [], [], [], [], []]
        load = 0
        for batch in batches:
            for uid, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = _words(packed)
                if len(words) < window:
                    continue
                first, n, anchor = _anchored(words, window, min(ANCHOR, window))
                joined = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                starts = np.append(0, ends[:-1] + 1)
                a, b = starts[first].tolist(), ends[first + n + window - 2].tolist()
                contents = _contents(map(joined.__getitem__, map(slice, a, b)))
                for column, values in zip(columns, (np.full(len(first), uid), first, n, anchor, *contents), strict=True):
                    column.append(values)
                load += len(first)
                if load > ROWS:
                    yield made(columns)
                    columns, load = [[], [], [], [], [], []], 0
        if load:
            yield made(columns)

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column's texts compressed one by one, as they move twice."""
    pack = zstandard.ZstdCompressor(3).compress
    for batch in batches:
        packed = [pack(t.as_py().encode()) if t.is_valid else None for t in batch.columns[-1]]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(packed, pa.binary())], batch.schema.names)


def _unpacked(packed: pa.Scalar) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed.as_py()) if packed.is_valid else b""


def _words(packed: pa.Scalar) -> list[bytes]:
    return _unpacked(packed).split()


_CLASS = pa.schema([("anchor", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("copies", pa.int64()), ("weight", pa.int64()), ("crowded", pa.bool_()), ("words", pa.string())])


def _slices(window: int):
    """Packed texts with the fragments to cut from them, as classes with their words."""

    def rows(batches):
        for batch in batches:
            for packed, wanted in zip(batch.column(0), batch.column(1), strict=True):
                words = _words(packed)
                for f in wanted.as_py():
                    yield f["anchor"], f["c1"], f["c2"], f["copies"], f["copies"], f["crowded"], b" ".join(words[f["start"] : f["start"] + f["n"] + window - 1]).decode()

    return lambda batches: batches_of(rows(batches), _CLASS, size=20_000, weight=4 << 20)


_FINER = pa.schema([("up_anchor", pa.int64()), ("up_c1", pa.int64()), ("up_c2", pa.int64()), ("up_weight", pa.int64()), ("at", pa.int32()), *list(_CLASS)[:4], ("words", pa.string())])


def _refined(window: int, run: int):
    """Classes cut into fragments by anchors of `run` words; only fragments of one anchor before share one now."""

    def rows(batches):
        for batch in batches:
            for anchor, c1, c2, copies, weight, _, text in zip(*batch.to_pydict().values(), strict=True):
                words = text.encode().split()
                first, n, finer = _anchored(words, window, run)
                with np.errstate(over="ignore"):
                    finer = finer * np.int64(0x9E3779B97F4A7C1) + np.int64(anchor)
                parts = [b" ".join(words[a : a + k + window - 1]) for a, k in zip(first.tolist(), n.tolist(), strict=True)]
                for at, key, d1, d2, part in zip(first.tolist(), finer.tolist(), *(c.tolist() for c in _contents(parts)), parts, strict=True):
                    yield anchor, c1, c2, weight, at, key, d1, d2, copies, part.decode()

    return lambda batches: batches_of(rows(batches), _FINER, size=20_000, weight=4 << 20)


_VERDICT = pa.schema([*list(_CLASS)[:3], ("weight", pa.int64()), ("hits", pa.list_(pa.int32()))])


def _runs(starts: list[int]) -> list[int]:
    """Consecutive window starts as flat pairs: first, last + 1, first, last + 1, ..."""
    out: list[int] = []
    for at in starts:
        if out and out[-1] == at:
            out[-1] = at + 1
        else:
            out += [at, at + 1]
    return out


def _search_shard(window: int):
    """Classes sorted by anchor: index after index over whole anchor groups, each searched for its own fragments."""

    def search(group: list[tuple]) -> Iterator[tuple]:
        symbols: dict[bytes, int] = {}
        coded = [np.array([symbols.setdefault(w, len(symbols) + 1) for w in words], np.int64) for *_, words in group]
        alone = [i for i, row in enumerate(group) if row[3] == 1]
        found = FMIndex(coded, window).repeated_windows([coded[i] for i in alone], window) if alone else []
        hits = dict(zip(alone, found, strict=True))
        for i, (anchor, c1, c2, _, weight, _, words) in enumerate(group):
            starts = hits[i].tolist() if i in hits else list(range(len(words) - window + 1))
            if starts:
                yield anchor, c1, c2, weight, _runs(starts)

    def rows(batches):
        group: list[tuple] = []
        load, last = 0, None
        for batch in batches:
            for *key, words in zip(*batch.to_pydict().values(), strict=True):
                if load > INDEX_WORDS and key[0] != last:
                    yield from search(group)
                    group, load = [], 0
                words = words.encode().split()
                group.append((*key, words))
                load, last = load + len(words), key[0]
        if group:
            yield from search(group)

    return lambda batches: batches_of(rows(batches), _VERDICT, size=20_000)


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.string(): "string", pa.list_(pa.int32()): "array<int>"}
    return ", ".join(f"{field.name} {names[field.type]}" for field in schema)


def _grouped(classes: DataFrame, window: int, run: int, crowd: int) -> DataFrame:
    """Classes (a table) of anchors with two rows or more, with `crowded`: whether their anchors of `run` words have too
    many of them for one index."""
    groups = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("contents"), F.sum("copies").alias("rows"))
    groups = cut(groups.filter("rows > 1").select("anchor", "contents", ((F.col("contents") > crowd) & F.lit(run < window)).alias("crowded")), "groups")
    return spread_join(classes, groups, ["anchor"], "contents", ["c1"]).drop("contents")


def _judged(classes: DataFrame, window: int, run: int, crowd: int) -> DataFrame:
    """Classes (a table with the columns of _CLASS, anchors of `run` words) that have repeated windows: their key, weight,
    and hits, flat pairs of a first repeated window and the one after the last."""
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few, many = classes.filter("NOT crowded"), classes.filter("crowded")
    found = few.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(releasing(_search_shard(window)), _ddl(_VERDICT))
    if many.isEmpty():
        return found
    longer = min(run + FINER, window)
    finer = cut(many.mapInArrow(releasing(_refined(window, longer)), _ddl(_FINER)), "finer")
    inner = finer.groupBy(*KEY, "words").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("weight"))
    inner = cut(_grouped(cut(inner, "finer-contents"), window, longer, crowd).select(_CLASS.names), "finer-classes")
    below = cut(_judged(inner, window, longer, crowd), "finer-verdicts")
    up = [f"up_{c}" for c in (*KEY, "weight")]
    moved = F.transform("hits", lambda x: x + F.col("at"))
    back = spread_join(finer.select(*up, "at", *KEY), below, KEY, "weight", ["up_c1", "at"])
    back = back.groupBy(*up).agg(F.flatten(F.collect_list(moved)).alias("hits"))
    return found.unionByName(back.select(*(F.col(u).alias(u[3:]) for u in up), "hits"))


def _covered(source: DataFrame, window: int, crowd: int) -> tuple[DataFrame, DataFrame]:
    """source has uid first and __text last. Returns a table of its rows with the text packed, and for each uid
    with repeated windows an array of (start, hits): windows start + hits[0] up to start + hits[1], and so on."""
    n = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = cut(source.mapInArrow(releasing(_packed), source.withColumn("__text", F.col("__text").cast("binary")).schema), "texts")
    bare = texts.select("uid", F.col("__text").alias("packed"))
    fragments = cut(bare.mapInArrow(releasing(_fragments(window)), _ddl(_FRAGMENTS)), "fragments")
    repeated = cut(fragments.groupBy("anchor").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "anchors")
    flagged = cut(spread_join(fragments, repeated, ["anchor"], "rows", ["uid", "start"]).drop("rows"), "flagged")
    # one number for (uid, start), so that the least of them needs no sort
    place = F.col("uid").cast("decimal(38,0)") * F.lit(1 << 31).cast("decimal(20,0)") + F.col("start")
    classes = flagged.groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.min(place.cast("decimal(38,0)")).alias("place"))
    classes = classes.select(
        *KEY, "copies", "n", F.expr(f"CAST(place div {1 << 31} AS BIGINT)").alias("uid"), F.expr(f"CAST(place % {1 << 31} AS INT)").alias("start")
    )
    classes = _grouped(cut(classes, "classes"), window, min(ANCHOR, window), crowd)
    wanted = classes.groupBy("uid").agg(F.collect_list(F.struct(*KEY, "copies", "n", "start", "crowded")).alias("wanted"))
    slices = bare.repartition(n, "uid").join(wanted, "uid").select("packed", "wanted").mapInArrow(releasing(_slices(window)), _ddl(_CLASS))
    verdicts = cut(_judged(cut(slices, "slices"), window, min(ANCHOR, window), crowd), "verdicts")
    covers = spread_join(flagged, verdicts, KEY, "weight", ["uid", "start"])
    return texts.repartition(n, "uid"), covers.groupBy("uid").agg(F.collect_list(F.struct("start", "hits")).alias("covers"))


def _kept(window: int, names: tuple[str, str, str]):
    """Rows (rest..., packed, covers) as (rest..., text, words before, words removed)."""

    def kept(packed, covers) -> tuple[str | None, int, int]:
        text = _unpacked(packed)
        words = text.split()
        if not covers.is_valid:
            return text.decode() if packed.is_valid else None, len(words), 0
        change = np.zeros(len(words) + 1, np.int64)
        for cover in covers.as_py():
            hits = np.array(cover["hits"], np.int64) + cover["start"]
            np.add.at(change, hits[::2], 1)
            np.add.at(change, hits[1::2] + window - 1, -1)
        left = [w for w, k in zip(words, (np.cumsum(change[:-1]) == 0).tolist(), strict=True) if k]
        return b" ".join(left).decode(), len(words), len(words) - len(left)

    def made(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        texts, words, removed = zip(*found, strict=True)
        columns = [*batch.columns[:-2], pa.array(texts, pa.string()), pa.array(words, pa.int64()), pa.array(removed, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-2], *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, load, found = 0, 0, []
            for i, (packed, covers) in enumerate(zip(batch.columns[-2], batch.columns[-1], strict=True)):
                found.append(kept(packed, covers))
                load += len(found[-1][0] or "")
                if load > BYTES:
                    yield made(batch.slice(begin, i + 1 - begin), found)
                    begin, load, found = i + 1, 0, []
            if found:
                yield made(batch.slice(begin), found)

    return run


def remove_repeats(
    docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW, crowd: int = CROWD,
    counts: tuple[str, str] = ("n_words", "n_removed"),
) -> DataFrame:
    """The columns of keep, text_col, and (named by counts) n_words and n_removed for every row. A text that loses words
    becomes its kept words joined by one space; any other text stays as it is.

    Words are runs of anything but space and \\x09-\\x0D. A null text has no words and stays null. Texts with fewer
    than `window` words lose nothing. Windows are judged on the input. Repeated rows count as documents of their
    own, so a text of a full window that comes twice loses all its words in both. A column of keep that is named like a
    result gives way to it; other columns may have any names. Fragments are equal where their anchor hashes and 128 bits over
    their words are.
    """
    keep = apart(keep, text_col, *counts)
    names = [f"__{i}" for i in range(len(keep))]
    results = ("__text", "__words", "__removed")
    source = docs.select(
        F.monotonically_increasing_id().alias("uid"), *(F.col(c).alias(x) for c, x in zip(keep, names, strict=True)), F.col(text_col).alias("__text")
    )
    texts, covers = _covered(source, window, crowd)
    out = texts.select(*names).schema.add("__text", "string").add("__words", "long").add("__removed", "long")
    found = texts.join(covers, "uid", "left").select(*names, "__text", "covers").mapInArrow(releasing(_kept(window, results)), out)
    return found.select(*(F.col(x).alias(c) for x, c in zip((*names, *results), (*keep, text_col, *counts), strict=True)))


def query(spark, sf_dir):
    found = remove_repeats(table(spark, sf_dir, "documents"))
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))
