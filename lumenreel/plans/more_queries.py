"""Queries over cut points, latest states, restated days, ports and partition replacement."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import jobs as J
from ..operators import selection as S
from ..operators import series as W
from ..operators import transcript as R
from ..operators import trends as D
from ..sources import store as P
from ..streaming.live import latest_state
from . import metrics_queries as Q
from . import store_queries as Y
from . import transcript_queries as X
from .registry import query
from .trend_queries import scored
from .views import read


@query("kind_default", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'music' ELSE 'video' END AS kind FROM {part}")
def _(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.when(F.col("p_partkey") % 3 == 0, "music"), F.lit("video")).alias("kind"))


@query("compact_number", f"SELECT o_orderkey, {Y.COMPACT} AS views FROM {{orders}}")
def _(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", J.readable_views(F.col("o_orderkey") * 97).alias("views"))


@query("silence_points", f"""SELECT source_id, round(CASE WHEN m BETWEEN lo AND hi THEN m WHEN a < lo AND lo < b THEN lo ELSE hi END, 3) AS point FROM (SELECT s.source_id, s.from_sec AS a, s.to_sec AS b, (s.from_sec + s.to_sec) / 2 AS m, 20.0 AS lo, 40.0 AS hi FROM
  (SELECT source_id, from_sec, to_sec FROM (SELECT source_id, coalesce(lag(end_sec) OVER (PARTITION BY source_id ORDER BY start_sec), 0) AS from_sec, start_sec AS to_sec FROM {X.SPEECH.replace('0.95', '0.25')} s) x WHERE round(to_sec - from_sec, 6) >= 0.2) s) t
  WHERE m BETWEEN lo AND hi OR (a < lo AND lo < b) OR (a < hi AND hi < b)""")
def _(spark, sf_dir):
    point = R.silence_point(F.col("from_sec"), F.col("to_sec"), F.lit(20.0), F.lit(40.0))
    return X.quiet(spark, sf_dir).select("source_id", F.round(point, 3).alias("point")).filter("point IS NOT NULL")


@query("push_out_of_words", f"""SELECT s.source_id, s.span_id, coalesce((SELECT min(w.start_sec) FROM {X.WORDS} w WHERE w.source_id = s.source_id AND w.start_sec < s.span_start AND s.span_start < w.end_sec), s.span_start) AS span_start FROM {X.SPAN.replace('{d}', X.DURATIONS)} s""")
def _(spark, sf_dir):
    return R.push_out_of_words(X.spans(spark, sf_dir), X.words(spark, sf_dir), "span_start", before=True).select("source_id", "span_id", "span_start")


def snapped(spark, sf_dir):
    return R.snap_bounds(X.spans(spark, sf_dir), X.words(spark, sf_dir), X.quiet(spark, sf_dir))


@query("snap_start")
def _(spark, sf_dir):
    return snapped(spark, sf_dir).select("source_id", "span_id", "start_sec", "start_snapped")


@query("snap_end")
def _(spark, sf_dir):
    return snapped(spark, sf_dir).select("source_id", "span_id", "end_sec", "end_snapped")


@query("part_metadata")
def _(spark, sf_dir):
    s = Y.series(spark, sf_dir)
    k = F.explode(F.sequence(F.lit(0), F.lit(5))).alias("part")
    parts = s.select("series_id").distinct().select("series_id", k).select("series_id", "part", (F.col("part") * 50 + 0.25).alias("p0"), (F.col("part") * 50 + 30.5).alias("p1"))
    return W.slice_keyframes(s, parts)


@query("live_query", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM {events}) e WHERE rn = 1 AND event_type <> 'error'")
def _(spark, sf_dir):
    changes = read(spark, sf_dir, "events").withColumn("deleted", F.col("event_type") == "error")
    return latest_state(changes, "user_id", "event_id").select("user_id", "event_id")


@query("revision_window", f"SELECT publication_id, day, views + CASE WHEN partial THEN 1 ELSE 0 END AS views FROM ({Q.SNAPSHOTS}) s")
def _(spark, sf_dir):
    from ..operators.history import upsert_unsettled

    old = Q.snapshots(spark, sf_dir)
    return upsert_unsettled(old, old.withColumn("views", F.col("views") + 1)).select("publication_id", "day", "views")


def _find(frames):
    for frame in frames:
        yield frame.assign(url="https://example.org/find?q=" + frame["topic"])[["ord", "url"]]


@query("video_finder_port", "SELECT ord, 'https://example.org/find?q=' || topic AS url FROM {signals}")
def _(spark, sf_dir):
    return P.with_finder(read(spark, sf_dir, "signals").select("ord", "topic"), _find, "ord long, url string")


def _judge(frames):
    for frame in frames:
        yield frame.assign(relevance=frame["label"].str.len() % 11, worth=frame["label"].str.len() % 3 > 0)


@query("curator_port")
def _(spark, sf_dir):
    ranked = D.rank_trends(scored(spark, sf_dir), 20).select("run_id", "cluster_no", "label", "score", "rank")
    judged = P.with_finder(ranked, _judge, ranked.withColumn("relevance", F.lit(0).cast("long")).withColumn("worth", F.lit(True)).schema)
    return D.rerank_curated(judged).select("run_id", "cluster_no", "rank", "place")


@query("replace_partition", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'new' ELSE 'old' END AS written FROM {orders}")
def _(spark, sf_dir):
    folder = spark.conf.get("spark.checkpoint.dir", None) or S._own_folder(spark)
    path = f"{folder.rstrip('/')}/replaced-{uuid.uuid4().hex}"
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("job_id"))
    P.replace_partition(rows.withColumn("written", F.lit("old")), path)
    P.replace_partition(rows.filter("job_id = 'F'").withColumn("written", F.lit("new")), path)
    return spark.read.parquet(path).select("o_orderkey", "written")
