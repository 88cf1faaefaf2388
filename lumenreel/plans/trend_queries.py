"""Queries over trend signals, videos and log records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logs as L
from ..operators import trends as D
from .registry import query
from .views import read


def clustered(spark, sf_dir):
    return D.cluster_signals(read(spark, sf_dir, "signals"))


@query("cluster_signals")
def _(spark, sf_dir):
    return clustered(spark, sf_dir).select("run_id", "ord", "cluster_no")


@query("cluster_measures")
def _(spark, sf_dir):
    return D.cluster_measures(clustered(spark, sf_dir)).select("run_id", "cluster_no", "signals", "sources", "strength", "newest_hours", "label")


@query("cluster_label", """SELECT run_id, substr(arg_min(topic, (CASE source WHEN 'GOOGLE_TRENDS' THEN 0 WHEN 'YOUTUBE' THEN 1 ELSE 2 END) * 1000000000000 + length(topic) * 100000000 + ord), 1, 80) AS label FROM {signals} GROUP BY run_id""")
def _(spark, sf_dir):
    return read(spark, sf_dir, "signals").groupBy("run_id").agg(D.cluster_label(F.col("source"), F.col("topic"), F.col("ord")).alias("label"))


def interests(spark):
    return spark.createDataFrame([("the of",), ("and was",), ("de la",), ("er",)], "interest string")


@query("interest_match")
def _(spark, sf_dir):
    return D.interest_match(D.cluster_measures(clustered(spark, sf_dir)), interests(spark))


def scored(spark, sf_dir):
    c = D.cluster_measures(clustered(spark, sf_dir)).withColumn("n_videos", F.col("cluster_no") % 3).withColumn("best_video", F.when(F.col("n_videos") > 0, F.col("cluster_no") % 100)).withColumn("matched", F.col("cluster_no") % 2)
    return c.withColumn("score", D.score_trend(c, 48))


@query("score_trend")
def _(spark, sf_dir):
    return scored(spark, sf_dir).select("run_id", "cluster_no", "score")


@query("rank_trends")
def _(spark, sf_dir):
    return D.rank_trends(scored(spark, sf_dir), 8).select("run_id", "rank", "score", "label")


@query("rerank_curated")
def _(spark, sf_dir):
    ranked = D.rank_trends(scored(spark, sf_dir), 20).withColumn("relevance", F.col("cluster_no") % 11).withColumn("worth", F.col("cluster_no") % 3 != 0)
    return D.rerank_curated(ranked).select("run_id", "cluster_no", "rank", "place", "blended")


FIRST = "list_first(list_filter(list({0} ORDER BY ord), lambda x: x IS NOT NULL))"


@query("dedupe_videos", f"""SELECT external_id, CASE WHEN max(CASE WHEN via = 'REDDIT' THEN 1 ELSE 0 END) = 1 THEN 'REDDIT' ELSE 'YOUTUBE' END AS via, {FIRST.format('channel')} AS channel,
  list_first(list_filter(list(duration_sec ORDER BY ord), lambda x: x IS NOT NULL AND x <> 0)) AS duration_sec, list_first(list_filter(list(view_count ORDER BY ord), lambda x: x IS NOT NULL AND x <> 0)) AS view_count, {FIRST.format('age_hours')} AS age_hours FROM {{video_hits}} GROUP BY external_id""")
def _(spark, sf_dir):
    return D.dedupe_videos(read(spark, sf_dir, "video_hits")).drop("ord", "title")


@query("trend_pipeline")
def _(spark, sf_dir):
    videos = read(spark, sf_dir, "video_hits").withColumn("label_token", F.lower(F.split_part("title", F.lit(" "), F.lit(1))))
    words = read(spark, sf_dir, "signals").select("ord", F.split_part(F.lower("topic"), F.lit(" "), F.lit(1)).alias("w"))
    videos = videos.join(words.withColumnRenamed("ord", "s"), videos.ord == F.col("s")).withColumn("label_token", F.col("w")).drop("s", "w")
    return D.trend_pipeline(read(spark, sf_dir, "signals"), videos, interests(spark), 48, 1200.0, 8)


def records(spark, sf_dir):
    e = F.col("event_id")
    stack = F.when(e % 3 == 0, F.lit('Traceback (most recent call last):\n  File "a.py", line 3, in f\n    g()\n  File "b.py", line 9, in g\n    raise X')).when(e % 3 == 1, F.lit("Error: x\n    at f (a.js:3:1)\n    at g (b.js:4:2)"))
    return read(spark, sf_dir, "log_records").withColumn("stack", stack)


STACK = "CASE WHEN event_id % 3 = 0 THEN 'File \"b.py\", line <n>, in g' WHEN event_id % 3 = 1 THEN 'at f (a.js:<n>:<n>)' ELSE '' END"


def _fingerprinted():
    from .text_queries import NORMAL_LOG

    return f"(SELECT *, substr(sha256(level || '|' || app || '|' || {NORMAL_LOG} || '|' || {STACK}), 1, 16) AS fingerprint FROM {{log_records}})"


@query("log_groups", f"SELECT fingerprint, count(*) AS count, min(ts) AS first_seen, max(ts) AS last_seen, arg_max(message, event_id) AS message FROM {_fingerprinted()} r GROUP BY fingerprint")
def _(spark, sf_dir):
    return L.log_groups(L.with_fingerprint(records(spark, sf_dir))).drop("stack")


@query("merge_groups")
def _(spark, sf_dir):
    r = L.with_fingerprint(records(spark, sf_dir))
    old = L.log_groups(r.filter("event_id % 2 = 0")).withColumn("status", F.lit("RESOLVED"))
    return L.merge_groups(old, L.log_groups(r.filter("event_id % 2 = 1")))


@query("keep_last_n", f"SELECT fingerprint, event_id FROM (SELECT fingerprint, event_id, row_number() OVER (PARTITION BY fingerprint ORDER BY ts DESC, event_id DESC) AS rn FROM {_fingerprinted()} r) x WHERE rn <= 25")
def _(spark, sf_dir):
    return L.keep_last_n(L.with_fingerprint(records(spark, sf_dir))).select("fingerprint", "event_id")


@query("rate_limit")
def _(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("app"), F.col("user_id").cast("string")).alias("app"), "ts")
    return L.rate_limit(e, 5, 3600.0)


JSON_STACK = r"""CASE WHEN event_id % 3 = 0 THEN ',"stack":"Traceback (most recent call last):\n  File \"a.py\", line 3, in f\n    g()\n  File \"b.py\", line 9, in g\n    raise X"' WHEN event_id % 3 = 1 THEN ',"stack":"Error: x\n    at f (a.js:3:1)\n    at g (b.js:4:2)"' ELSE '' END"""


@query("log_export_json", f"""SELECT fingerprint, concat('{{"fingerprint":"', fingerprint, '","count":', count(*), ',"firstSeen":"', strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%g'), 'Z","lastSeen":"', strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%g'), 'Z","message":"', arg_max(message, (ts, event_id)), '"', arg_max({JSON_STACK}, (ts, event_id)), '}}') AS json
  FROM {_fingerprinted()} r GROUP BY fingerprint""")
def _(spark, sf_dir):
    return L.export_json(L.log_groups(L.with_fingerprint(records(spark, sf_dir))))


@query("log_export_markdown")
def _(spark, sf_dir):
    return L.export_markdown(L.log_groups(L.with_fingerprint(records(spark, sf_dir))))
