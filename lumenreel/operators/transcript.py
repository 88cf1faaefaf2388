"""Transcripts: words, segments, sliding windows, silences and caption cues.

Range joins always have the source as an equi key and, where a source can be long, a time bin beside it, so that
one long source is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import in_parts, running
from .selection import cut

BIN = 30.0


def words_of_turns(turns: DataFrame) -> DataFrame:
    """Conversation turns as timed words: each word lasts 0.3 s, one follows another by 0.4 s, a turn by 0.8 s more."""
    split = turns.select(F.col("conv_id").alias("source_id"), F.col("turn").alias("segment"), F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("ws"))
    w = Window.partitionBy("source_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    split = split.withColumn("before", F.coalesce(F.sum(F.size("ws")).over(w), F.lit(0))).withColumn("turns_before", F.coalesce(F.count(F.lit(1)).over(w), F.lit(0)))
    rows = split.select("source_id", "segment", "before", "turns_before", F.posexplode("ws").alias("word_no", "text"))
    start = F.round((F.col("before") + F.col("word_no")) * 0.4 + F.col("turns_before") * 0.8, 2)
    return rows.select("source_id", "segment", "word_no", "text", start.alias("start_sec"), F.round(start + 0.3, 2).alias("end_sec"), ((F.length("text") % 10) / 10).alias("probability"))


def segments_of_words(words: DataFrame) -> DataFrame:
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_no", "text"))), lambda x: x.text), " ")
    return words.groupBy("source_id", "segment").agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), said.alias("text"))


def bins(start: Column, end: Column, width: float = BIN) -> Column:
    return F.sequence(F.floor(start / width), F.floor(end / width))


def words_in(words: DataFrame, spans: DataFrame, width: float = BIN) -> DataFrame:
    """Words that overlap a span at all. spans: source_id, span_id, span_start, span_end.

    A word is looked for in the bins of both; it is counted in the first bin that word and span share.
    """
    w = words.withColumn("bin", F.explode(bins(F.col("start_sec"), F.col("end_sec"), width)))
    s = spans.withColumn("bin", F.explode(bins(F.col("span_start"), F.col("span_end"), width)))
    met = w.join(s, ["source_id", "bin"]).filter("end_sec > span_start AND start_sec < span_end")
    return met.filter(F.col("bin") == F.greatest(F.floor(F.col("start_sec") / width), F.floor(F.col("span_start") / width))).drop("bin")


def clip_confidence(words: DataFrame, spans: DataFrame) -> DataFrame:
    """Word count and mean probability inside each span; null probability isn't zero."""
    found = words_in(words, spans).groupBy("source_id", "span_id").agg(F.count(F.lit(1)).alias("word_count"), F.avg("probability").alias("mean_confidence"))
    return spans.select("source_id", "span_id").join(found, ["source_id", "span_id"], "left").withColumn("word_count", F.coalesce("word_count", F.lit(0)))


def window_spec(longest: Column) -> tuple[Column, Column]:
    """(width, stride): the longest clip and 30 s; a quarter of that, at least 30 s."""
    width = F.greatest(F.lit(120.0), longest + 30.0)
    return width, F.greatest(F.lit(30.0), width / 4)


def sliding_windows(segments: DataFrame, width: float = 120.0, stride: float = 30.0) -> DataFrame:
    """(source_id, window_no, start_sec, end_sec, segments, n): windows by overlap, empty ones left out, numbered densely;
    the first window that reaches the end is the last. Each segment computes the windows it lies in, so nothing is
    compared that doesn't meet."""
    spans = segments.groupBy("source_id").agg(F.max("end_sec").alias("duration")).filter("duration > 0")
    last = F.greatest(F.ceil((F.col("duration") - width) / stride), F.lit(0))
    joined = segments.join(spans, "source_id")
    low = F.greatest(F.floor((F.col("start_sec") - width) / stride) + 1, F.lit(0))
    high = F.least(F.ceil(F.col("end_sec") / stride) - 1, last)
    rows = joined.filter(low <= high).select("source_id", "segment", "start_sec", "end_sec", "text", "duration", F.explode(F.sequence(low, high)).alias("k"))
    rows = rows.withColumn("w0", F.col("k") * F.lit(stride)).withColumn("w1", F.least(F.col("k") * F.lit(stride) + width, F.col("duration")))
    rows = rows.filter("end_sec > w0 AND start_sec < w1")
    parts = F.sort_array(F.collect_list(F.struct("start_sec", "segment", "end_sec", "text"))).alias("segments")
    made = rows.groupBy("source_id", "k", "w0", "w1").agg(parts, F.count(F.lit(1)).alias("n"))
    number = F.row_number().over(Window.partitionBy("source_id").orderBy("k")) - 1
    return made.select("source_id", number.alias("window_no"), F.col("w0").alias("start_sec"), F.col("w1").alias("end_sec"), "segments", "n")


def render_window(windows: DataFrame) -> DataFrame:
    lines = F.transform("segments", lambda s: F.format_string("[%.1f-%.1f] %s", s.start_sec, s.end_sec, s.text))
    return windows.select("source_id", "window_no", F.array_join(lines, "\n").alias("text"))


def speech_spans(segments: DataFrame, gap: float = 0.25) -> DataFrame:
    """Segments less than a gap from the one before run on as one span."""
    key, order = ["source_id"], ["start_sec", "segment"]
    parts = in_parts(segments.select("source_id", "start_sec", "segment", "end_sec"), key, order)
    ended = running(parts, key, order, last_end=("last", F.col("end_sec")))
    marked = cut(ended.withColumn("new", F.coalesce((F.col("start_sec") - F.col("last_end") >= gap).cast("int"), F.lit(1))).drop("last_end"))
    numbered = running(marked, key, order, before=("sum", F.col("new")))
    return numbered.withColumn("span_no", F.coalesce("before", F.lit(0)) + F.col("new")).groupBy("source_id", "span_no").agg(
        F.min("start_sec").alias("start_sec"), F.max_by("end_sec", F.struct("start_sec", "segment")).alias("end_sec")
    )


def silences(spans: DataFrame, durations: DataFrame, least: float = 0.20) -> DataFrame:
    """What speech leaves free between 0 and the duration, of at least a length."""
    key, order = ["source_id"], ["last", "start_sec", "end_sec"]
    end = durations.select("source_id", F.lit(1).alias("last"), F.col("duration").alias("start_sec"), F.lit(None).cast("double").alias("end_sec"))
    rows = in_parts(spans.select("source_id", F.lit(0).alias("last"), "start_sec", "end_sec").unionByName(end), key, order)
    free = running(rows, key, order, reached=("max", F.col("end_sec"))).select("source_id", F.coalesce("reached", F.lit(0.0)).alias("from_sec"), F.col("start_sec").alias("to_sec"))
    return free.filter(F.round(F.col("to_sec") - F.col("from_sec"), 6) >= least)


def caption_cues(words: DataFrame, budget: int = 32, gap: float = 0.6, clips: DataFrame | None = None) -> DataFrame:
    """Words in cues: a cue ends at a pause or when the next word, each with a space, would pass the character budget.

    With clips (source_id, clip_id, clip_start, clip_end) there are cues for each clip: of the words that it shows, in its
    own time, and words over its edges for the part that is seen. Without, a source is one clip.
    """
    key = ["source_id"]
    if clips is not None:
        key = ["source_id", "clip_id"]
        spans = clips.select(*key, F.col("clip_start").alias("span_start"), F.col("clip_end").alias("span_end")).withColumn("span_id", F.col("clip_id"))
        start, end = F.greatest(F.lit(0.0), F.col("start_sec") - F.col("span_start")), F.least("span_end", "end_sec") - F.col("span_start")
        words = words_in(words, spans).withColumn("end_sec", F.round(end, 6)).withColumn("start_sec", F.round(start, 6)).filter("end_sec > start_sec")
    order = ["segment", "word_no"]
    said = in_parts(words.select(*key, "segment", "word_no", "start_sec", "end_sec", F.trim("text").alias("text")), key, order)
    ended = running(said, key, order, last_end=("last", F.col("end_sec")))
    marked = cut(ended.withColumn("new", F.coalesce((F.round(F.col("start_sec") - F.col("last_end"), 6) > gap).cast("int"), F.lit(1))).drop("last_end"))
    numbered = running(marked, key, order, before=("sum", F.col("new")))
    islands = numbered.withColumn("island", F.coalesce("before", F.lit(0)) + F.col("new")).groupBy(*key, "island").agg(
        F.sort_array(F.collect_list(F.struct("segment", "word_no", "start_sec", "end_sec", "text"))).alias("ws")
    )
    cue = "struct<start_sec:double,end_sec:double,text:string>"
    start = F.struct(F.array().cast(f"array<{cue}>").alias("done"), F.lit(None).cast(cue).alias("now"))

    def step(state, word):
        joined = F.concat(state.now.text, F.lit(" "), word.text)
        over = state.now.isNull() | (F.length(joined) + 1 > budget)
        fresh = F.struct(word.start_sec.alias("start_sec"), word.end_sec.alias("end_sec"), word.text.alias("text"))
        longer = F.struct(state.now.start_sec.alias("start_sec"), word.end_sec.alias("end_sec"), joined.alias("text"))
        done = F.when(state.now.isNotNull() & over, F.concat(state.done, F.array(state.now))).otherwise(state.done)
        return F.struct(done.alias("done"), F.when(over, fresh).otherwise(longer).alias("now"))

    cues = F.aggregate("ws", start, step, lambda s: F.concat(s.done, F.array(s.now)))
    return islands.select(*key, "island", F.posexplode(cues).alias("cue", "c")).select(*key, "island", "cue", "c.*")


def snap_bounds(clips: DataFrame, words: DataFrame, quiet: DataFrame, back: float = 3.0, forward: float = 3.0) -> DataFrame:
    """Clip bounds moved to silences near their first and last words, never into a word, kept inside the source.

    clips: source_id, span_id, span_start, span_end, duration. quiet: source_id, from_sec, to_sec. The start goes to the
    latest point of a silence in the 3 s before the first word, the end to the earliest in the 3 s after the last;
    without one they keep 0.05 s off the words.
    """
    key = ["source_id", "span_id"]
    first = words_in(words, clips).groupBy(*key).agg(F.min_by("start_sec", F.struct("segment", "word_no")).alias("a0"), F.max_by("end_sec", F.struct("segment", "word_no")).alias("a1"))
    base = clips.join(first, key, "left")
    s_high = F.coalesce("a0", "span_start")
    e_low = F.coalesce("a1", "span_end")
    base = base.withColumn("s_high", s_high).withColumn("s_low", F.greatest(F.lit(0.0), s_high - back)).withColumn("e_low", e_low).withColumn("e_high", F.least("duration", e_low + forward))
    reach = F.explode(bins(F.least("s_low", "e_low"), F.greatest("s_high", "e_high"))).alias("bin")  # in several bins alike, which max and min don't mind
    still = quiet.select("*", F.explode(bins(F.col("from_sec"), F.col("to_sec"))).alias("bin"))
    near = base.select(*key, "s_low", "s_high", "e_low", "e_high", reach).join(still, ["source_id", "bin"]).filter("(to_sec >= s_low AND from_sec <= s_high) OR (to_sec >= e_low AND from_sec <= e_high)")
    points = near.groupBy(*key).agg(
        F.max(silence_point(F.col("from_sec"), F.col("to_sec"), F.col("s_low"), F.col("s_high"))).alias("s_point"),
        F.min(silence_point(F.col("from_sec"), F.col("to_sec"), F.col("e_low"), F.col("e_high"))).alias("e_point"),
    )
    placed = base.join(points, key, "left").select(
        *key, "duration", F.coalesce("s_point", F.greatest(F.lit(0.0), F.col("s_high") - 0.05)).alias("s"), F.coalesce("e_point", F.least("duration", F.col("e_low") + 0.05)).alias("e"),
        F.col("s_point").isNotNull().alias("start_snapped"), F.col("e_point").isNotNull().alias("end_snapped"),
    )
    start = push_out_of_words(placed, words, "s", before=True)
    both = push_out_of_words(start, words, "e", before=False)
    return both.select(*key, F.greatest(F.col("s"), F.lit(0.0)).alias("start_sec"), F.least("e", "duration").alias("end_sec"), "start_snapped", "end_snapped")


def silence_point(start: Column, end: Column, low: Column, high: Column) -> Column:
    """A silence's cut point in [low, high]: its middle, or the edge of the range that lies inside it."""
    middle = (start + end) / 2
    return F.when((middle >= low) & (middle <= high), middle).when((start < low) & (low < end), low).when((start < high) & (high < end), high)


def push_out_of_words(rows: DataFrame, words: DataFrame, column: str, before: bool, width: float = BIN) -> DataFrame:
    """Times strictly inside a word move to its start or its end; the first such word counts."""
    w = words.select("source_id", "start_sec", "end_sec", "segment", "word_no", F.explode(bins(F.col("start_sec"), F.col("end_sec"), width)).alias("bin"))
    at = rows.withColumn("bin", F.floor(F.col(column) / width))
    hit = at.join(w, ["source_id", "bin"]).filter((F.col("start_sec") < F.col(column)) & (F.col(column) < F.col("end_sec")))
    to = hit.groupBy("source_id", "span_id").agg(F.min_by("start_sec" if before else "end_sec", F.struct("segment", "word_no")).alias("to"))
    return rows.join(to, ["source_id", "span_id"], "left").withColumn(column, F.coalesce("to", column)).drop("to")
