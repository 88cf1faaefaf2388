"""Time series and paths: windows of most mass, sections, periods, smoothing, simplification, interpolation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(by: str, order: str = "t"):
    return Window.partitionBy(by).orderBy(order)


def best_window_profile(profile: DataFrame, width: int, by: str = "series_id") -> DataFrame:
    """Per series the fixed-width window of most mass; of equal ones the one nearest the centroid. t is 0, 1, 2, ..."""
    w = _w(by)
    mass = F.sum("value").over(w.rowsBetween(0, width - 1))
    ahead = F.count(F.lit(1)).over(w.rowsBetween(0, width - 1))
    centroid = F.sum(F.col("t") * F.col("value")).over(Window.partitionBy(by)) / F.nullif(F.sum("value").over(Window.partitionBy(by)), F.lit(0.0))
    rows = profile.select(by, "t", mass.alias("mass"), ahead.alias("n"), centroid.alias("centroid")).filter(F.col("n") == width)
    best = F.max("mass").over(Window.partitionBy(by))
    near = rows.withColumn("best", best).filter(F.col("mass") >= F.col("best") - F.greatest(F.lit(1e-9), F.abs(F.col("best")) * 1e-6))
    return near.groupBy(by).agg(F.min_by("t", F.struct(F.abs(F.col("t") + width / 2 - F.col("centroid")), "t")).alias("left"), F.max("mass").alias("mass"))


def loudest_window(samples: DataFrame, seconds: int, by: str = "series_id") -> DataFrame:
    """Root mean square per second, to six places, and the run of seconds with the largest sum, of equal ones the first. Decimals
    add up exactly, so equal sums are equal in whatever order they were added."""
    rms = samples.groupBy(by, F.floor("t").alias("second")).agg(F.sqrt(F.avg(F.col("value") ** 2)).cast("decimal(28,6)").alias("rms"))
    w = _w(by, "second").rangeBetween(0, seconds - 1)
    return rms.withColumn("sum", F.sum("rms").over(w)).groupBy(by).agg(F.max_by("second", F.struct("sum", -F.col("second"))).alias("start"))


def peak_section(series: DataFrame, beats: DataFrame, width: int, by: str = "series_id") -> DataFrame:
    """The most energetic window of `width` steps that ends inside the series, moved back to the beat before it."""
    w = _w(by).rowsBetween(0, width - 1)
    rows = series.select(by, "t", F.sum("value").over(w).alias("mass"), F.count(F.lit(1)).over(w).alias("n")).filter(F.col("n") == width)
    peak = rows.groupBy(by).agg(F.max_by("t", F.struct("mass", -F.col("t"))).alias("peak"))
    beat = peak.join(beats, by, "left").filter("beat IS NULL OR beat <= peak").groupBy(by, "peak").agg(F.max("beat").alias("beat"))
    return peak.join(beat, [by, "peak"], "left").select(by, F.coalesce("beat", "peak").alias("start"))


def shared_scale(curves: DataFrame, value: str) -> DataFrame:
    """All curves over one ceiling, at least 1, never one per curve."""
    ceiling = curves.agg(F.greatest(F.lit(1.0), F.max(value)).alias("ceiling"))
    return curves.crossJoin(F.broadcast(ceiling)).withColumn("scaled", F.col(value) / F.col("ceiling"))


def smooth_path(path: DataFrame, window: int, max_step: float, by: str = "series_id") -> DataFrame:
    """A moving average whose edges are held, then a limit on each step (none if it isn't above 0). The limit depends on
    the step before, so a series' points pass in order, and only the last one is held."""
    half = window // 2
    whole = Window.partitionBy(by)
    w = _w(by).rowsBetween(-half, window - 1 - half)
    ordered = _w(by)
    rows = path.select(by, "t", "value", F.sum("value").over(w).alias("s"), F.count(F.lit(1)).over(w).alias("n"), F.row_number().over(ordered).alias("i"), F.count(F.lit(1)).over(whole).alias("all"),
                       F.first("value").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("a"), F.last("value").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("z"))
    left = F.greatest(F.lit(half) - (F.col("i") - 1), F.lit(0))
    average = (F.col("s") + left * F.col("a") + (F.lit(window) - F.col("n") - left) * F.col("z")) / window
    smooth = rows.select(by, "t", (F.col("value") if window <= 1 else average).cast("double").alias("value"))
    if max_step <= 0:
        return smooth

    def limit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series, last = None, 0.0
        for frame in frames:
            out = []
            for key, value in zip(frame[by], frame["value"], strict=True):
                last = value if key != series else last + max(-max_step, min(max_step, value - last))
                series = key
                out.append(last)
            yield frame.assign(value=out)

    return smooth.repartition(by).sortWithinPartitions(by, "t").mapInPandas(limit, smooth.schema)


def simplify_path(path: DataFrame, tolerance: float, by: str = "series_id", durations: DataFrame | None = None) -> DataFrame:
    """First and last points, and those further than a tolerance from the line between the last kept and the next.

    With durations (by, duration) points are keyframes: times rounded to 3 places and held to the duration, values
    rounded to 2 and held to 0 to 100, and a series without points is one in the middle at time 0.
    """
    points = path.select(by, F.col("t").cast("double").alias("t"), F.col("value").cast("double").alias("value"))

    def thin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series, kept, waiting = None, None, None  # waiting: the point that the next one decides on
        for frame in frames:
            out = []
            for point in zip(frame[by], frame["t"], frame["value"], strict=True):
                key, t, value = point
                if key != series:
                    out += [waiting] if waiting else []
                    out.append(point)
                    series, kept, waiting = key, point, None
                    continue
                if waiting and t > kept[1]:
                    on_line = kept[2] + (value - kept[2]) * (waiting[1] - kept[1]) / (t - kept[1])
                    if abs(waiting[2] - on_line) > tolerance:
                        kept = waiting
                        out.append(waiting)
                waiting = point
            yield pd.DataFrame(out, columns=[by, "t", "value"])
        if waiting:
            yield pd.DataFrame([waiting], columns=[by, "t", "value"])

    kept = points.repartition(by).sortWithinPartitions(by, "t").mapInPandas(thin, points.schema)
    if durations is None:
        return kept
    t, value = F.round(F.least("t", "duration"), 3), F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("value"))), 2)
    return durations.join(kept, by, "left").select(by, F.when(F.col("t").isNull(), 0.0).otherwise(t).alias("t"), F.when(F.col("t").isNull(), 50.0).otherwise(value).alias("value"))


#: Points of a block of a series at least; a longer series is transformed block by block.
BLOCK = 1 << 16


def _correlated(low: int, high: int, size: int, by: str):
    """Sorted rows (by, block, t, v) as (by, lag, s, pairs): products of a block's own points with those a lag on, by transform."""

    def of(key, block, t: np.ndarray, v: np.ndarray) -> pd.DataFrame:
        place, own = t - t[0], t < (block + 1) * size
        n = int(place[-1]) + 1
        width = 1 << int(2 * n - 1).bit_length()

        def products(values: np.ndarray) -> np.ndarray:
            first, all_ = np.zeros(n), np.zeros(n)
            np.add.at(first, place[own], values[own])
            np.add.at(all_, place, values)
            return np.fft.irfft(np.fft.rfft(first, width).conj() * np.fft.rfft(all_, width), width)[low : min(high + 1, n)]

        s, pairs = products(v), np.rint(products(np.ones(len(v)))).astype(np.int64)
        met = np.flatnonzero(pairs > 0)
        return pd.DataFrame({by: pd.Series([key] * len(met), dtype=object), "lag": (met + low).astype(np.int32), "s": s[met]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            parts = [p for _, p in frame.groupby([by, "block"], sort=False, dropna=False)]
            for part in parts:
                if held and (held[0][by].iloc[0], held[0]["block"].iloc[0]) != (part[by].iloc[0], part["block"].iloc[0]):
                    yield ended(held)
                    held = []
                held.append(part)
        if held:
            yield ended(held)

    def ended(held: list[pd.DataFrame]) -> pd.DataFrame:
        whole = pd.concat(held) if len(held) > 1 else held[0]
        return of(whole[by].iloc[0], int(whole["block"].iloc[0]), whole["t"].to_numpy(np.int64), whole["v"].to_numpy(float))

    return run


def lag_correlations(series: DataFrame, low: int, high: int, by: str = "series_id") -> DataFrame:
    """Autocorrelation per lag over a lag range, for lags at which points meet.

    A series is cut into blocks of BLOCK points of time (four times the range at least), each with the points of the range after it, and
    a block's sums for all lags come from one transform. So a point moves once, or twice at a border, whatever the range.
    """
    size = max(BLOCK, 4 * high)
    means = series.groupBy(by).agg(F.avg("value").alias("__mean"))
    centred = series.join(means, by).select(by, F.col("t").cast("long").alias("t"), (F.col("value") - F.col("__mean")).cast("double").alias("v"))
    zero = centred.groupBy(by).agg(F.sum(F.col("v") ** 2).alias("v0"), F.count(F.lit(1)).alias("n"))
    block = F.floor(F.col("t") / size)
    blocks = F.when(F.col("t") - block * size < high, F.array(block, block - 1)).otherwise(F.array(block))
    n = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = centred.filter("t IS NOT NULL AND v IS NOT NULL").select(by, F.explode(blocks).alias("block"), "t", "v").repartition(n, by, "block").sortWithinPartitions(by, "block", "t")
    schema = series.select(by).schema.add("lag", "integer").add("s", "double")
    sums = dealt.mapInPandas(_correlated(low, high, size, by), schema).groupBy(by, "lag").agg(F.sum("s").alias("s"))
    return sums.join(zero, by).filter("v0 > 0").select(by, "lag", (F.col("s") / F.col("v0")).alias("r"), "n")


def dominant_period(series: DataFrame, low: int, high: int, by: str = "series_id", least: int = 32) -> DataFrame:
    """The lag of the largest autocorrelation, or null where that is weak: below 0.15 or within 1.5 times the mean, or
    of fewer than 32 points."""
    r = lag_correlations(series, low, high, by).groupBy(by).agg(F.max_by("lag", F.struct("r", -F.col("lag"))).alias("lag"), F.max("r").alias("strength"), F.avg("r").alias("mean"), F.max("n").alias("n"))
    clear = (F.col("n") >= least) & (F.col("strength") >= 0.15) & (F.col("strength") > 1.5 * F.col("mean"))
    return r.select(by, F.when(clear, F.col("lag")).alias("period"), "strength")


def phase_grid(series: DataFrame, period: int, by: str = "series_id") -> DataFrame:
    """The offset within a period whose points have the largest mean."""
    per = series.groupBy(by, F.pmod("t", F.lit(period)).alias("offset")).agg(F.avg("value").alias("mean"))
    return per.groupBy(by).agg(F.max_by("offset", F.struct("mean", -F.col("offset"))).alias("offset"))


def motion_profile(frames: DataFrame, floor: float, by: str = "series_id") -> DataFrame:
    """Absolute change between frames per column, changes up to a noise floor left out, summed."""
    change = F.abs(F.col("value") - F.lag("value").over(Window.partitionBy(by, "column").orderBy("frame")))
    return frames.withColumn("d", change).groupBy(by, "column").agg(F.sum(F.when(F.col("d") > floor, F.col("d")).otherwise(0.0)).alias("energy"))


def slice_keyframes(keys: DataFrame, parts: DataFrame, by: str = "series_id", width: float = 30.0) -> DataFrame:
    """A path cut to parts: inside points re-based, both edges interpolated. keys: by, t, value; parts: by, part, p0, p1.

    Points meet parts in time bins; an edge takes the last point before it from the points in order.
    """
    cell = lambda c: F.floor(F.col(c) / width)
    held = parts.select("*", F.explode(F.sequence(cell("p0"), cell("p1"))).alias("bin"))
    inside = keys.withColumn("bin", cell("t")).join(held, [by, "bin"]).filter("t > p0 AND t < p1").select(by, "part", (F.col("t") - F.col("p0")).alias("t"), "value")
    w = _w(by)
    spans = keys.select(by, "t", F.struct("t", "value", F.lead("t").over(w).alias("t1"), F.lead("value").over(w).alias("v1")).alias("key"))
    edges = parts.select(by, F.explode(F.array("p0", "p1")).alias("t"), F.struct("part", "p0").alias("edge"))
    order = Window.partitionBy(by).orderBy("t", F.col("edge").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = spans.unionByName(edges, allowMissingColumns=True).withColumn("key", F.last("key", ignorenulls=True).over(order)).filter("edge IS NOT NULL AND key IS NOT NULL")
    k = F.col("key")
    value = F.when(k.t1.isNull() | (k.t1 <= k.t), k.value).otherwise(k.value + (k.v1 - k.value) * (F.col("t") - k.t) / (k.t1 - k.t))
    return inside.unionByName(met.select(by, "edge.part", (F.col("t") - F.col("edge.p0")).alias("t"), value.alias("value"))).distinct()


def speaking_at(scenes: DataFrame, times: DataFrame, by: str = "scene_id", width: float = 30.0) -> DataFrame:
    """Who speaks at each time, or null. Times meet scenes in time bins."""
    spans = scenes.select("*", F.explode(F.sequence(F.floor(F.col("start_sec") / width), F.floor(F.col("end_sec") / width))).alias("bin"))
    hit = times.withColumn("bin", F.floor(F.col("at") / width)).join(spans, [by, "bin"]).filter("at >= start_sec AND at < end_sec").groupBy(by, "at").agg(F.min_by("speaker", "start_sec").alias("speaker"))
    return times.join(hit, [by, "at"], "left")


def time_scenes(scenes: DataFrame, by: str = "script_id") -> DataFrame:
    """Scene starts from their first line; a silent scene takes the next one's start; starts never fall."""
    ahead = Window.partitionBy(by).orderBy("scene").rowsBetween(0, Window.unboundedFollowing)
    so_far = Window.partitionBy(by).orderBy("scene").rowsBetween(Window.unboundedPreceding, 0)
    s = scenes.withColumn("s", F.coalesce(F.first("first_line_sec", ignorenulls=True).over(ahead), "total_sec")).withColumn("start_sec", F.max("s").over(so_far))
    return s.withColumn("end_sec", F.coalesce(F.lead("start_sec").over(Window.partitionBy(by).orderBy("scene")), "total_sec")).drop("s")


def interpolate(curve: Column, point: float) -> Column:
    from ..functions.metrics import retention_at

    return retention_at(curve, point)
