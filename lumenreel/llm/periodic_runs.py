"""Runs of repeated word sequences, found by recursive frequency splitting.

A run is a stretch of words with a smallest period q, as long as `exponent` periods and `least` words at least, that no
neighbouring word extends. Every word of a run occurs in it `exponent` times, so a word that occurs less often in a segment
belongs to no run there and splits it; in the parts words have become rarer, so that goes on until no segment changes.
Segments that are left are scanned lag by lag.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import apart, table

EXPONENT, LEAST = 4, 6
#: Bytes of texts that are split together, a longer text alone. Lags up to DENSE compare each place with the one a lag on.
BLOCK, DENSE = 4 << 20, 8
RUNS = ArrayType(StructType([StructField(name, LongType()) for name in ("start", "length", "period")]))


def segments(words: np.ndarray, group: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> list[np.ndarray]:
    """Places of the segments in which a run may lie. words are numbers; group never falls, and a segment is of one group."""
    place = np.arange(len(words))
    segment = np.cumsum(np.append(0, np.diff(group) != 0)) if len(group) else group
    done: list[np.ndarray] = []
    while True:
        size = np.bincount(segment)[segment] if len(segment) else segment
        keep = size >= least
        place, segment = place[keep], segment[keep]
        if not len(place):
            return done
        _, kind, often = np.unique(segment * (int(words.max()) + 1) + words[place], return_inverse=True, return_counts=True)
        rare = often[kind] < exponent
        split = np.zeros(int(segment[-1]) + 1, bool)
        split[segment[rare]] = True
        whole = ~split[segment]
        stable = place[whole]
        if len(stable):
            done += np.split(stable, np.flatnonzero(np.diff(segment[whole]) != 0) + 1)
        rest = ~(whole | rare)
        place, before = place[rest], segment[rest]
        segment = np.cumsum(np.append(0, (np.diff(place) != 1) | (np.diff(before) != 0))) if len(place) else place


def _stretch(words: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The longest stretch of places around `at` that equal the places a lag on: first, last + 1."""
    last, step = at, 64
    end = len(words) - lag
    while last < end:
        same = words[last : min(last + step, end)] == words[last + lag : min(last + step, end) + lag]
        if not same.all():
            last += int(same.argmin())
            break
        last, step = last + len(same), step * 2
    first, step = at, 64
    while first > 0:
        begin = max(0, first - step)
        same = (words[begin:first] == words[begin + lag : first + lag])[::-1]
        if not same.all():
            first -= int(same.argmin())
            break
        first, step = begin, step * 2
    return first, last


def scan(words: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs of a segment as (start, length, period), from a scan of every lag that has room for one.

    A run with period q has at least (exponent - 1) * q consecutive places that equal the places q on, and among so many
    are exponent - 1 multiples of q; beyond small lags only multiples of q are compared, and what is found is extended.
    A stretch found with a smaller period has that one: its longer period is a multiple of it.
    """
    n, found, smallest = len(words), [], {}
    long: list[tuple[int, int, int]] = []
    for lag in range(1, n // exponent + 1):
        need = max(least - lag, (exponent - 1) * lag)
        spans = []
        if lag <= DENSE:
            other = np.flatnonzero(words[:-lag] != words[lag:])
            bounds = np.concatenate([[-1], other, [n - lag]])
            for i in np.flatnonzero(np.diff(bounds) > need).tolist():
                spans.append((int(bounds[i]) + 1, int(bounds[i + 1])))
        else:
            some = words[::lag]
            same = some[:-1] == some[1:]
            for _ in range(exponent - 2):
                same = same[:-1] & same[1:]
            hits = np.flatnonzero(same)
            if not len(hits):
                continue
            long = [r for r in long if r[1] >= exponent * lag]
            beyond = -1
            for at in (hits * lag).tolist():
                if at < beyond:
                    continue
                known = next((s + size for s, size, p in long if s <= at and at + lag < s + size and lag % p == 0), None)
                if known is not None:
                    beyond = known - lag
                    continue
                first, last = _stretch(words, at, lag)
                beyond = last
                if last - first >= need:
                    spans.append((first, last))
        for first, last in spans:
            if (first, last + lag) not in smallest:
                smallest[first, last + lag] = lag
                found.append((first, last + lag - first, lag))
                long.append(found[-1])
    return found


def _words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts, and where each text's begin."""
    lists = pc.ascii_split_whitespace(texts)
    words, bounds = lists.values, lists.offsets.to_numpy()
    some = pc.not_equal(words, pa.scalar("", words.type)).to_numpy(zero_copy_only=False)
    return words.filter(pa.array(some)).dictionary_encode(), np.append(0, np.cumsum(some))[bounds]


def _searched(texts: pa.Array, exponent: int, least: int) -> tuple[pa.Array, pa.Array]:
    """Each text's runs by start and period, and its words but those after a run's first period, joined by a space."""
    words, bounds = _words(texts)
    codes = words.indices.to_numpy().astype(np.int64)
    group = np.repeat(np.arange(len(texts)), np.diff(bounds))
    rows: list[tuple[int, int, int]] = []
    for places in segments(codes, group, exponent, least):
        rows += [(int(places[0]) + start, length, period) for start, length, period in scan(codes[places], exponent, least)]
    rows.sort(key=lambda r: (r[0], r[2]))
    start, length, period = np.array(rows, np.int64).reshape(-1, 3).T
    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    keep = np.cumsum(change)[:-1] == 0
    left = pa.LargeListArray.from_arrays(np.append(0, np.cumsum(keep))[bounds], words.filter(pa.array(keep)).dictionary_decode())
    of = np.searchsorted(bounds, start, side="right") - 1
    runs = pa.StructArray.from_arrays([pa.array(start - bounds[of]), pa.array(length), pa.array(period)], ["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(start, bounds), pa.int32()), runs)
    return lists, pc.binary_join(left, pa.scalar(" ", pa.large_string()))


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices with texts of together at most BLOCK bytes, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, first = np.cumsum(sizes), 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + BLOCK, side="right")))
        yield batch.slice(first, last - first)
        first = last


def find_runs(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """The columns of keep, runs (array of start, length, period, by start and then period) and collapsed for every row.

    Words are runs of anything but space and \\x09-\\x0D, numbered from 0. A run has the smallest period q of its words, is
    at least max(least, exponent * q) words long, and ends where its period does. collapsed has the text's words without
    those that any run has after its first q words, joined by one space. A null text has no words: no runs, an empty string.
    Texts are read whole, repeated rows stay repeated, ids may be null, an empty table stays empty. A column of keep that is
    named like a result gives way to it; other columns may have any names.
    """
    if exponent < 2 or least < 1:
        raise ValueError("a run has two periods at least")
    keep = apart(keep, "runs", "collapsed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, len(keep)):
                texts = pc.fill_null(part.column(len(keep)).cast(pa.large_string()), "")
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *_searched(texts, exponent, least)], [*names, "runs", "collapsed"])

    names = [f"__{i}" for i in range(len(keep))]
    source = docs.select(*(F.col(c).alias(x) for c, x in zip(keep, names, strict=True)), F.col(text_col).cast("string").alias("__text"))
    found = source.mapInArrow(run, source.select(*names).schema.add("runs", RUNS).add("collapsed", "string"))
    return found.select(*(F.col(x).alias(c) for x, c in zip(names, keep, strict=True)), "runs", "collapsed")


def _repeated_tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text): of each tenth document by hash, the words from some place on become a repetition."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for i, key in enumerate(batch.column(0).to_pylist()):
            h = zlib.crc32(str(key).encode()) if key is not None else 1
            words = (texts[i] or "").encode().split() if h % 10 == 0 else []
            if words:
                n, g = len(words), h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                times = -(-(n - a) // p)
                texts[i] = b" ".join(words[:a] + (words[a : a + p] * times)[: n - a]).decode()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def damaged(docs: DataFrame) -> DataFrame:
    """doc_id and text of every row, with repetitions put into every tenth document; a null id or text is left alone."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_repeated_tails, "doc_id long, text string")


def query(spark, sf_dir):
    found = find_runs(damaged(table(spark, sf_dir, "documents")))

    def first(a, b):
        x, y = a.length * b.period, b.length * a.period
        return F.when(x != y, F.when(x > y, -1).otherwise(1)).when(a.start != b.start, F.when(a.start < b.start, -1).otherwise(1)).otherwise(F.when(a.period < b.period, -1).otherwise(F.when(a.period > b.period, 1).otherwise(0)))

    line = F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")))
    best = F.get(F.array_sort("runs", first), F.lit(0))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
        F.sha2(F.concat_ws("", F.transform(line, lambda x: F.concat(x, F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )
