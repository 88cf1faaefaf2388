"""Choosing windows: overlap suppression, ranking, and the selection pipeline."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import product
from math import frexp

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as M


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark) -> str:
    """The folder that spark.checkpoint.dir names, or one of its own for a session of one machine."""
    return (spark.conf.get("spark.checkpoint.dir", None) or _own_folder(spark)).rstrip("/")


def _own_folder(spark) -> str:
    """A folder for a session of one machine; others must name one that all executors share."""
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def suppress(
    rows: DataFrame, group: str, order: list[Column], bounds: list[tuple[str, str]], conflict: Callable[[tuple, tuple], bool], width: float, ratio: float | None = None
) -> DataFrame:
    """Rows kept best first: one goes if a better kept one of its group conflicts with it.

    bounds names the lower and upper bound of each dimension (one for windows, two for rectangles); only rows that overlap
    can conflict, and with a ratio only those whose extents are within it. Of rows with equal bounds only the best can stay. conflict
    is asked about two boxes (x0, x1, y0, y1), or in one dimension about a window and two arrays, the bounds of many.
    Rows with null or empty extents conflict with none.

    The rest is cut into blocks `width` wide (four times the longest extent at least), and each block goes through its rows in
    order: a row that conflicts with a kept one goes, one that may depend on a row outside, or on an undecided better one, stays
    undecided, the others are kept. In the next round blocks are shifted by half, then twice as wide, so a chain of rows that each depend on
    the one before takes a number of rounds that grows with the logarithm of its length. What is kept and can't meet an undecided
    row any more isn't carried on. With a ratio, rows whose extents differ by more than it all along are families with
    blocks of their own, so a few long rows don't widen the blocks of all.
    """
    extents = [F.col(b) - F.col(a) for a, b in bounds]
    solid = reduce(lambda x, y: x & y, (e > 0 for e in extents))
    same = Window.partitionBy(group, *(c for pair in bounds for c in pair)).orderBy(*order)
    best = rows.filter(solid).withColumn("__place", F.row_number().over(same)).filter("__place = 1").drop("__place").withColumn("__kept", F.lit(False))
    band = F.floor(F.log(ratio, reduce(F.greatest, extents))) if ratio else F.lit(0).cast("long")
    first = cut(best.withColumn("__band", band))
    flat = rows.filter(~F.coalesce(solid, F.lit(False)))
    longest = [f"__longest{i}" for i in range(len(bounds))]
    found = first.groupBy(group, "__band").agg(*(F.max(e).cast("double").alias(name) for e, name in zip(extents, longest, strict=True)))
    bands = Window.partitionBy(group).orderBy("__band")
    # a band without rows parts two families: what lies on its sides differs by more than the ratio
    begins = F.coalesce((F.col("__band") - F.lag("__band").over(bands) > 1).cast("int"), F.lit(0))
    found = found.withColumn("__begins", begins).withColumn("__family", F.sum("__begins").over(bands))
    whole = Window.partitionBy(group, "__family")
    found = found.select(group, "__band", "__family", *(F.max(name).over(whole).alias(name) for name in longest))
    state = first.join(found, [group, "__band"]).drop("__band")
    blocks = [f"__block{i}" for i in range(len(bounds))]
    extra = ["__family", *longest, "__kept"]
    shifts, done, turn = list(product((0.5, 0.0), repeat=len(bounds))), [flat], 0
    while True:
        shift, wider = shifts[turn % len(shifts)], 2.0 ** (turn // len(shifts))
        widths = [F.greatest(F.lit(float(width)), F.col(name) * 4) * wider for name in longest]
        placed = state.withColumns({name: F.floor(F.col(a) / w + s) for name, (a, _), w, s in zip(blocks, bounds, widths, shift, strict=True)})
        dealt = placed.repartition(group, "__family", *blocks).sortWithinPartitions(group, "__family", *blocks, F.desc("__kept"), *order)
        decide = _decide_line if len(bounds) == 1 else _decide
        decided = cut(dealt.mapInArrow(decide(group, bounds, blocks, longest, conflict, width, wider, shift, ratio), placed.schema).drop(*blocks))
        open_ = decided.filter("NOT __kept")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, [decided.drop(*extra), *done])
        cells = [F.floor(F.col(a) / F.col(name)) for (a, _), name in zip(bounds, longest, strict=True)]
        places = [f"__cell{i}" for i in range(len(bounds))]
        near = open_.select(group, "__family", *(c.alias(p) for c, p in zip(cells, places, strict=True)))
        for p in places:
            near = near.withColumn(p, F.explode(F.array(F.col(p) - 1, F.col(p), F.col(p) + 1)))
        near, keys = near.distinct(), [group, "__family", *places]
        kept = decided.filter("__kept").withColumns(dict(zip(places, cells, strict=True)))
        done.append(kept.join(near, keys, "left_anti").select(rows.columns))
        state = open_.unionByName(kept.join(near, keys, "left_semi").select(decided.columns))
        turn += 1


class _Near:
    """Boxes by cells of their size: of a box's own level and the two beside it if extents are bounded by 2, else of all levels."""

    def __init__(self, top: int, bounded: bool):
        self.top, self.bounded = top, bounded
        self.own: dict[tuple, list[tuple]] = {}
        self.inner: dict[tuple, list[tuple]] = {}

    def level(self, box: tuple) -> int:
        """A level above the binary logarithm of a box's longest extent; very small boxes share one."""
        return max(frexp(max(b - a for a, b in zip(box[::2], box[1::2], strict=True)))[1], self.top - 24)

    def add(self, box: tuple) -> None:
        level = self.level(box)
        self.own.setdefault((level, *self._cell(box, level)), []).append(box)
        if not self.bounded:
            for higher in range(level + 1, self.top + 1):
                self.inner.setdefault((higher, *self._cell(box, higher)), []).append(box)

    def _cell(self, box: tuple, level: int) -> tuple:
        return tuple(int(a // 2.0**level) for a in box[::2])

    def around(self, box: tuple) -> Iterator[tuple]:
        """Every box that can meet this one, and some others."""
        level = self.level(box)
        for other in range(level - 1, level + 2) if self.bounded else range(level, self.top + 1):
            steps = (-1, 0, 1, 2) if other < level else (-1, 0, 1)
            for cell in product(*(tuple(c + s for s in steps) for c in self._cell(box, other))):
                yield from self.own.get((other, *cell), ())
                if other == level and not self.bounded:
                    yield from self.inner.get((other, *cell), ())


def _decide(group: str, bounds: list[tuple[str, str]], blocks: list[str], longest: list[str], conflict: Callable, width: float, wider: float, shift: tuple, ratio: float | None):
    """Blocks of sorted rows without those that go, and with __kept for those that are decided to stay."""
    dims = range(len(bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept, open_ = None, None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (group, "__family", *blocks, *longest, "__kept", *(c for pair in bounds for c in pair))]
            takes, verdicts = [], []
            for i, row in enumerate(zip(*columns, strict=True)):
                block, most = row[: 2 + len(dims)], row[2 + len(dims) : 2 + 2 * len(dims)]
                done, box = row[2 + 2 * len(dims)], tuple(map(float, row[3 + 2 * len(dims) :]))
                if block != now:
                    now, top = block, frexp(max(most))[1]
                    kept, open_ = _Near(top, bool(ratio) and ratio <= 2), _Near(top, bool(ratio) and ratio <= 2)
                if not done:
                    if any(conflict(other, box) for other in kept.around(box)):
                        continue
                    sides = [max(width, 4.0 * m) * wider for m in most]
                    low = [(block[2 + d] - shift[d]) * sides[d] for d in dims]
                    reach = [min(most[d], ratio * (box[2 * d + 1] - box[2 * d])) if ratio else most[d] for d in dims]
                    inside = all(box[2 * d] - reach[d] >= low[d] and box[2 * d + 1] <= low[d] + sides[d] for d in dims)
                    done = inside and not any(conflict(other, box) for other in open_.around(box))
                (kept if done else open_).add(box)
                takes.append(i)
                verdicts.append(done)
            out = batch.take(pa.array(takes, pa.int64()))
            yield out.set_column(batch.schema.get_field_index("__kept"), "__kept", pa.array(verdicts, pa.bool_()))

    return run


class _Line:
    """A block's windows that stay so far, best first: bounds, and whether each is decided."""

    def __init__(self):
        self.low, self.high, self.done = np.zeros(0), np.zeros(0), np.zeros(0, bool)

    def take(self, low: np.ndarray, high: np.ndarray, kept: np.ndarray, reach: Callable, inside: Callable, conflict: Callable) -> tuple[np.ndarray, np.ndarray]:
        """Goes through further windows in order; gives which of them stay, and which of all are decided.

        A window that stays strikes the windows about it, which are neighbours by their lower bounds, all at once.
        """
        before, low, high = len(self.low), np.append(self.low, low), np.append(self.high, high)
        fixed, done = np.append(self.done, kept), np.append(self.done, kept)
        order = np.argsort(low, kind="stable")
        place = np.empty(len(low), np.int64)
        place[order] = np.arange(len(low))
        lows, highs, far = low[order], high[order], reach(high - low)
        first = np.searchsorted(lows, low - far * (1 + 1e-9)).tolist()
        last = np.searchsorted(lows, high).tolist()
        safe, struck, waits, stays = inside(low, high, far), np.zeros(len(low), bool), np.zeros(len(low), bool), np.ones(len(low), bool)
        for i, at in enumerate(place.tolist()):
            if i >= before and not fixed[i]:
                if struck[at]:
                    stays[i] = False
                    continue
                done[i] = safe[i] and not waits[at]
            near = slice(first[i], last[i])
            marks = (struck if done[i] else waits)[near]
            marks |= conflict((low[i], high[i]), (lows[near], highs[near]))
        self.low, self.high, self.done = low[stays], high[stays], done[stays]
        return stays[before:], done[before:]


def _decide_line(group: str, bounds: list[tuple[str, str]], blocks: list[str], longest: list[str], conflict: Callable, width: float, wider: float, shift: tuple, ratio: float | None):
    """`_decide` for windows: a block's rows of a batch are taken together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, line = None, _Line()
        for batch in batches:
            n = batch.num_rows
            keys = [batch.column(c) for c in (group, "__family", *blocks)]
            codes = [pc.fill_null(k.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False) for k in keys]
            begins = np.flatnonzero(reduce(np.logical_or, (np.diff(c, prepend=c[:1] - 1) != 0 for c in codes))).tolist() if n else []
            low, high, longs = (pc.cast(batch.column(c), pa.float64(), safe=False).to_numpy(zero_copy_only=False) for c in (*bounds[0], longest[0]))
            kept = batch.column("__kept").to_numpy(zero_copy_only=False)
            stays, done = np.zeros(n, bool), np.zeros(n, bool)
            for i, j in zip(begins, [*begins[1:], n], strict=True):
                key = tuple(k[i].as_py() for k in keys)
                if key != now:
                    now, line = key, _Line()
                most = float(longs[i])
                side = max(width, 4.0 * most) * wider
                edge = (key[2] - shift[0]) * side
                reach = lambda size, most=most: np.minimum(most, ratio * size) if ratio else np.full(len(size), most)
                inside = lambda a, b, far, edge=edge, side=side: (a - far >= edge) & (b <= edge + side)
                stays[i:j], done[i:j] = line.take(low[i:j], high[i:j], kept[i:j], reach, inside, conflict)
            out = batch.filter(pa.array(stays))
            yield out.set_column(batch.schema.get_field_index("__kept"), "__kept", pa.array(done[stays], pa.bool_()))

    return run


def _alike(threshold: float) -> Callable[[tuple, tuple], np.ndarray]:
    """Whether a window's shared length with each of many is more than a threshold of what both cover."""

    def conflict(a: tuple, b: tuple) -> np.ndarray:
        shared = np.minimum(a[1], b[1]) - np.maximum(a[0], b[0])
        return (shared > 0) & (shared / ((a[1] - a[0]) + (b[1] - b[0]) - shared) > threshold)

    return conflict


def greedy_suppress(windows: DataFrame, group: str, order: list[Column], threshold: float = 0.5, width: float = 1800.0) -> DataFrame:
    """Windows (group, start_sec, end_sec, ...) kept best first: one goes if a better kept one of its group overlaps it by
    more than the threshold."""
    return suppress(windows, group, order, [("start_sec", "end_sec")], _alike(threshold), width, max(2.0, 1.0 / threshold) if threshold > 0 else None)


def top_candidates(windows: DataFrame, total: Column, shortest: float = 15.0, longest: float = 75.0, floor: int = 0, limit: int = 5, group: str = "source_id", ties: tuple[str, ...] = ("id",)) -> DataFrame:
    """Rescored, filtered by length and floor, and the best per source: total, then start, then the ties."""
    length = F.col("end_sec") - F.col("start_sec")
    fit = windows.withColumn("total", total).filter((length >= shortest) & (length <= longest) & (F.col("total") >= floor))
    w = Window.partitionBy(group).orderBy(F.desc("total"), "start_sec", *ties)
    return fit.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def rescore_movement(windows: DataFrame, before: Column, after: Column, group: str, ties: tuple[str, ...]) -> DataFrame:
    """Place before and after a change of weights, per group."""
    a = F.row_number().over(Window.partitionBy(group).orderBy(before.desc(), *ties))
    b = F.row_number().over(Window.partitionBy(group).orderBy(after.desc(), *ties))
    return windows.withColumn("old_place", a).withColumn("new_place", b).withColumn("moved", F.col("old_place") - F.col("new_place"))


def best_per_source(windows: DataFrame, sources: DataFrame, fallback: float = 30.0) -> DataFrame:
    """The best window of each source, else the middle of the source, else nothing but the reason."""
    w = Window.partitionBy("source_id").orderBy(F.desc("total"), "start_sec", "id")
    best = windows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("source_id", F.col("start_sec").alias("b0"), F.col("end_sec").alias("b1"))
    half = F.least(F.lit(fallback), F.col("duration")) / 2
    joined = sources.join(best, "source_id", "left")
    return joined.select(
        "source_id", F.coalesce("b0", F.when(F.col("duration") > 0, F.col("duration") / 2 - half)).alias("start_sec"),
        F.coalesce("b1", F.when(F.col("duration") > 0, F.col("duration") / 2 + half)).alias("end_sec"),
        F.when(F.col("b0").isNotNull(), "best").when(F.col("duration") > 0, "middle").otherwise("nothing to cut").alias("how"),
    )


def segment_budget(n: Column, target: float, cap: float) -> Column:
    return F.greatest(F.lit(5.0), F.least(F.lit(cap), F.lit(target) / n))


def clamp_window(start: Column, end: Column, most: Column) -> Column:
    """struct(start, end, trimmed): cut at its end to a budget."""
    return F.struct(start.alias("start"), F.least(end, start + most).alias("end"), (end - start > most).alias("trimmed"))


def compile_select(segments: DataFrame, target: float, cap: float) -> DataFrame:
    """Per compilation: its windows trimmed to the budget; one with fewer than two usable segments is rejected."""
    w = Window.partitionBy("compilation_id")
    n = F.count(F.lit(1)).over(w)
    usable = F.sum((F.col("end_sec") > F.col("start_sec")).cast("int")).over(w)
    c = segments.withColumn("c", clamp_window(F.col("start_sec"), F.col("end_sec"), segment_budget(n, target, cap)))
    return c.withColumn("rejected", usable < 2).select("compilation_id", "segment_id", "c.*", "rejected")


def select_candidates(proposals: DataFrame, words: DataFrame, quiet: DataFrame, durations: DataFrame, total: Column, limit: int = 5) -> DataFrame:
    """Drop inverted and escaping proposals, suppress overlaps, snap, filter by length, rank: in that order."""
    from .transcript import snap_bounds

    words, quiet, durations = cut(words), cut(quiet), cut(durations)  # each is read several times
    good = proposals.join(durations, "source_id").filter("end_sec > start_sec AND start_sec >= 0 AND end_sec <= duration + 0.5").withColumn("total", total)
    kept = greedy_suppress(good.select("source_id", "id", "start_sec", "end_sec", "total"), "source_id", [F.desc("total"), F.col("start_sec"), F.col("id")])
    spans = kept.join(durations, "source_id").select("source_id", F.col("id").alias("span_id"), F.col("start_sec").alias("span_start"), F.col("end_sec").alias("span_end"), "duration")
    snapped = snap_bounds(spans, words, quiet).withColumnRenamed("span_id", "id")
    return top_candidates(snapped.join(kept.select("id", "total"), "id"), F.col("total"), limit=limit)
