"""Queries over transcripts, windows and their selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..operators import corpus as K
from ..operators import selection as S
from ..operators import transcript as R
from .metrics_queries import TOTAL_SQL, sub_scores
from .registry import query
from .views import read

WORDS = """(SELECT conv_id AS source_id, turn AS segment, i - 1 AS word_no, ws[i] AS text, round((before + i - 1) * 0.4::DOUBLE + turns_before * 0.8::DOUBLE, 2) AS start_sec,
  round(round((before + i - 1) * 0.4::DOUBLE + turns_before * 0.8::DOUBLE, 2) + 0.3::DOUBLE, 2) AS end_sec, (length(ws[i]) % 10) / 10.0::DOUBLE AS probability
  FROM (SELECT *, unnest(generate_series(1, len(ws))) AS i FROM (SELECT conv_id, turn, ws, coalesce(sum(len(ws)) OVER w, 0) AS before, count(*) OVER w AS turns_before FROM
  (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM {conversations}) a WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) b) c)"""
SEGMENTS = f"(SELECT source_id, segment, min(start_sec) AS start_sec, max(end_sec) AS end_sec, string_agg(text, ' ' ORDER BY word_no) AS text FROM {WORDS} w GROUP BY source_id, segment)"
DURATIONS = f"(SELECT source_id, max(end_sec) AS duration FROM {WORDS} w GROUP BY source_id)"
SPAN = "(SELECT source_id, k AS span_id, k * 45.0::DOUBLE + 3 AS span_start, k * 45.0::DOUBLE + 33 AS span_end FROM {d} d, (VALUES (0), (1), (2)) v(k))"


def words(spark, sf_dir):
    return R.words_of_turns(read(spark, sf_dir, "conversations"))


def segments(spark, sf_dir):
    return R.segments_of_words(words(spark, sf_dir))


def durations(spark, sf_dir):
    return words(spark, sf_dir).groupBy("source_id").agg(F.max("end_sec").alias("duration"))


def spans(spark, sf_dir):
    k = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("span_id")
    return durations(spark, sf_dir).select("source_id", "duration", k).select("source_id", "span_id", (F.col("span_id") * 45.0 + 3).alias("span_start"), (F.col("span_id") * 45.0 + 33).alias("span_end"), "duration")


@query("transcript_segments", f"SELECT source_id, segment, start_sec, end_sec FROM {SEGMENTS} s")
def _(spark, sf_dir):
    return segments(spark, sf_dir).drop("text")


@query("words_in", f"SELECT w.source_id, s.span_id, w.segment, w.word_no FROM {WORDS} w JOIN {SPAN.replace('{d}', DURATIONS)} s ON s.source_id = w.source_id AND w.end_sec > s.span_start AND w.start_sec < s.span_end")
def _(spark, sf_dir):
    return R.words_in(words(spark, sf_dir), spans(spark, sf_dir)).select("source_id", "span_id", "segment", "word_no")


@query("clip_facts_confidence", f"SELECT s.source_id, s.span_id, count(w.text) AS word_count, round_even(avg(w.probability), 4) AS mean_confidence FROM {SPAN.replace('{d}', DURATIONS)} s LEFT JOIN {WORDS} w ON s.source_id = w.source_id AND w.end_sec > s.span_start AND w.start_sec < s.span_end GROUP BY 1, 2")
def _(spark, sf_dir):
    return R.clip_confidence(words(spark, sf_dir), spans(spark, sf_dir)).withColumn("mean_confidence", F.bround("mean_confidence", 4))


WINDOWS = f"""(SELECT source_id, k, least(k * 30.0::DOUBLE + 120, duration) AS w1, k * 30.0::DOUBLE AS w0 FROM (SELECT source_id, duration, unnest(generate_series(0, CAST(greatest(ceil((duration - 120) / 30), 0) AS INT))) AS k FROM {DURATIONS} d) x)"""


@query("sliding_windows", f"""SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY k) - 1 AS window_no, w0 AS start_sec, w1 AS end_sec, n FROM
  (SELECT w.source_id, w.k, w.w0, w.w1, count(*) AS n FROM {WINDOWS} w JOIN {SEGMENTS} s ON s.source_id = w.source_id AND s.end_sec > w.w0 AND s.start_sec < w.w1 GROUP BY 1, 2, 3, 4) g""")
def _(spark, sf_dir):
    return R.sliding_windows(segments(spark, sf_dir)).drop("segments")


@query("render_window", f"""SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY k) - 1 AS window_no, text FROM (SELECT w.source_id, w.k, string_agg('[' || printf('%.1f', s.start_sec) || '-' || printf('%.1f', s.end_sec) || '] ' || s.text, chr(10) ORDER BY s.start_sec) AS text
  FROM {WINDOWS} w JOIN {SEGMENTS} s ON s.source_id = w.source_id AND s.end_sec > w.w0 AND s.start_sec < w.w1 GROUP BY 1, 2) g""")
def _(spark, sf_dir):
    return R.render_window(R.sliding_windows(segments(spark, sf_dir)))


SPEECH = f"""(SELECT source_id, span_no, min(start_sec) AS start_sec, arg_max(end_sec, start_sec) AS end_sec FROM (SELECT *, sum(new) OVER (PARTITION BY source_id ORDER BY start_sec) AS span_no FROM
  (SELECT *, CASE WHEN start_sec - lag(end_sec) OVER (PARTITION BY source_id ORDER BY start_sec) < 0.95 THEN 0 ELSE 1 END AS new FROM {SEGMENTS} s) a) b GROUP BY 1, 2)"""


@query("speech_spans", f"SELECT source_id, CAST(span_no AS BIGINT) AS span_no, start_sec, end_sec FROM {SPEECH} s")
def _(spark, sf_dir):
    return R.speech_spans(segments(spark, sf_dir), 0.95)


def quiet(spark, sf_dir):
    return R.silences(R.speech_spans(segments(spark, sf_dir)), durations(spark, sf_dir))


@query("silences", f"""SELECT source_id, round(from_sec, 2) AS from_sec, round(to_sec, 2) AS to_sec FROM (SELECT source_id, coalesce(lag(end_sec) OVER (PARTITION BY source_id ORDER BY start_sec), 0) AS from_sec, start_sec AS to_sec
  FROM {SPEECH.replace('0.95', '0.25')} s) x WHERE round(to_sec - from_sec, 6) >= 0.2""")
def _(spark, sf_dir):
    return quiet(spark, sf_dir).select("source_id", F.round("from_sec", 2).alias("from_sec"), F.round("to_sec", 2).alias("to_sec"))


@query("caption_cues")
def _(spark, sf_dir):
    return R.caption_cues(words(spark, sf_dir))


@query("snap_bounds")
def _(spark, sf_dir):
    return R.snap_bounds(spans(spark, sf_dir), words(spark, sf_dir), quiet(spark, sf_dir))


@query("source_excerpt", f"""SELECT source_id, span_id, CASE WHEN length(t) > 600 THEN rtrim(left(t, 600)) || '…' ELSE t END AS text FROM (SELECT s.source_id, s.span_id, trim(regexp_replace(string_agg(g.text, ' ' ORDER BY g.start_sec), '\\s+', ' ', 'g')) AS t
  FROM {SPAN.replace('{d}', DURATIONS)} s JOIN {SEGMENTS} g ON g.source_id = s.source_id AND g.end_sec > s.span_start AND g.start_sec < s.span_end GROUP BY 1, 2) x""")
def _(spark, sf_dir):
    seg = segments(spark, sf_dir).select("source_id", "segment", F.col("start_sec").alias("seg_start"), F.col("end_sec").alias("seg_end"), "text")
    return K.source_excerpt(seg, spans(spark, sf_dir))


def scored(spark, sf_dir):
    c = read(spark, sf_dir, "candidates")
    return c.withColumn("id", F.concat_ws("-", "order_id", "line", "part", "source_id")).withColumn("total", M.total_score(sub_scores()))


IDS = "concat_ws('-', order_id, line, part, source_id)"


@query("top_candidates", f"""SELECT id, source_id, total, rank FROM (SELECT {IDS} AS id, source_id, total, row_number() OVER (PARTITION BY source_id ORDER BY total DESC, start_sec, {IDS}) AS rank
  FROM (SELECT *, {TOTAL_SQL} AS total FROM {{candidates}}) c WHERE end_sec - start_sec BETWEEN 15 AND 75 AND total >= 40) x WHERE rank <= 5""")
def _(spark, sf_dir):
    return S.top_candidates(scored(spark, sf_dir), F.col("total"), floor=40).select("id", "source_id", "total", "rank")


@query("rescore_movement", f"""SELECT id, old_place, new_place, old_place - new_place AS moved FROM (SELECT {IDS} AS id, row_number() OVER (PARTITION BY source_id ORDER BY {TOTAL_SQL} DESC, {IDS}) AS old_place,
  row_number() OVER (PARTITION BY source_id ORDER BY hook DESC, {IDS}) AS new_place FROM {{candidates}}) x""")
def _(spark, sf_dir):
    return S.rescore_movement(scored(spark, sf_dir), F.col("total"), F.col("hook"), "source_id", ("id",)).select("id", "old_place", "new_place", "moved")


@query("greedy_suppress")
def _(spark, sf_dir):
    return S.greedy_suppress(scored(spark, sf_dir).select("source_id", "id", "start_sec", "end_sec", "total"), "source_id", [F.desc("total"), F.col("start_sec"), F.col("id")])


@query("best_per_source", f"""SELECT s.s_suppkey AS source_id, coalesce(b.start_sec, 285.0) AS start_sec, coalesce(b.end_sec, 315.0) AS end_sec, CASE WHEN b.start_sec IS NOT NULL THEN 'best' ELSE 'middle' END AS how FROM {{supplier}} s LEFT JOIN
  (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY {TOTAL_SQL} DESC, start_sec, {IDS}) AS rn FROM {{candidates}}) x WHERE rn = 1) b ON b.source_id = s.s_suppkey""")
def _(spark, sf_dir):
    sources = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), F.lit(600.0).alias("duration"))
    return S.best_per_source(scored(spark, sf_dir), sources)


@query("compile_select", """SELECT order_id AS compilation_id, concat_ws('-', order_id, line, part, source_id) AS segment_id, start_sec AS start, least(end_sec, start_sec + greatest(5.0, least(20.0, 60.0 / n))) AS "end",
  end_sec - start_sec > greatest(5.0, least(20.0, 60.0 / n)) AS trimmed, n < 2 AS rejected FROM (SELECT *, count(*) OVER (PARTITION BY order_id) AS n FROM {candidates}) c""")
def _(spark, sf_dir):
    return S.compile_select(scored(spark, sf_dir).select(F.col("order_id").alias("compilation_id"), F.col("id").alias("segment_id"), "start_sec", "end_sec"), 60.0, 20.0)


@query("select_candidates")
def _(spark, sf_dir):
    d = durations(spark, sf_dir)
    k = F.explode(F.sequence(F.lit(0), F.lit(7)))
    p = d.select("source_id", k.alias("k")).select("source_id", F.concat_ws("-", "source_id", "k").alias("id"), (F.col("k") * 12.0).alias("start_sec"), (F.col("k") * 12.0 + 20 + F.col("k") % 3 * 9).alias("end_sec"), (F.col("source_id") * 7 + F.col("k") * 13).alias("seed"))
    return S.select_candidates(p, words(spark, sf_dir), quiet(spark, sf_dir), d, (F.col("seed") % 101).cast("int"))
