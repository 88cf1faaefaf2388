"""Queries over metric history, cohorts, calibration and scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..operators import calibration as C
from ..operators import history as H
from .registry import query
from .views import read

TODAY = "2024-01-30"
FIRST = "2024-01-01"
COUNTER_SQL = "CAST(coalesce({0}, 0) AS BIGINT) AS {0}"
SNAPSHOTS = """SELECT p.publication_id, CAST(g.d AS DATE) AS day, CAST(coalesce(m.views, 0) AS BIGINT) AS views, CAST(coalesce(m.likes, 0) AS BIGINT) AS likes,
  CAST(coalesce(m.comments, 0) AS BIGINT) AS comments, CAST(coalesce(m.shares, 0) AS BIGINT) AS shares, m.average_view_percentage,
  m.publication_id IS NULL OR date_diff('day', CAST(g.d AS DATE), DATE '2024-01-30') <= 3 AS partial,
  greatest(date_diff('day', CAST(p.published_at AS DATE), CAST(g.d AS DATE)), 0) AS days_since_publish
  FROM {publications} p CROSS JOIN generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY) g(d)
  LEFT JOIN {metric_daily} m ON m.publication_id = p.publication_id AND m.day = CAST(g.d AS DATE)"""


def today():
    return F.lit(TODAY).cast("date")


def ranges(spark, sf_dir):
    return read(spark, sf_dir, "publications").select(
        "publication_id", F.lit(FIRST).cast("date").alias("start"), F.lit(TODAY).cast("date").alias("end"), "published_at"
    )


def snapshots(spark, sf_dir):
    daily = read(spark, sf_dir, "metric_daily").drop("minutes")
    return H.calendar_fill(ranges(spark, sf_dir), daily, today())


def pct(c="average_view_percentage"):
    return F.bround(c, 4).alias(c)


@query("calendar_fill", f"SELECT * REPLACE (round_even(average_view_percentage, 4) AS average_view_percentage) FROM ({SNAPSHOTS}) s")
def _(spark, sf_dir):
    return snapshots(spark, sf_dir).withColumn("average_view_percentage", pct()).withColumn("days_since_publish", F.col("days_since_publish").cast("long"))


@query("missing_days", "SELECT p.publication_id, CAST(g.d AS DATE) AS day FROM {publications} p CROSS JOIN generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY) g(d) WHERE NOT EXISTS (SELECT 1 FROM {metric_daily} m WHERE m.publication_id = p.publication_id AND m.day = CAST(g.d AS DATE))")
def _(spark, sf_dir):
    return H.missing_days(ranges(spark, sf_dir), read(spark, sf_dir, "metric_daily"))


@query("published_only", "SELECT publication_id, external_id FROM {publications} WHERE state = 'PUBLISHED' AND external_id IS NOT NULL")
def _(spark, sf_dir):
    return H.published_only(read(spark, sf_dir, "publications")).select("publication_id", "external_id")


@query("poll_range", """SELECT publication_id, CASE WHEN external_id IS NOT NULL THEN least(greatest(CAST(published_at AS DATE), DATE '2024-01-02'), DATE '2024-01-30') END AS start,
  CASE WHEN external_id IS NOT NULL THEN DATE '2024-01-30' END AS "end", CASE WHEN external_id IS NULL THEN 'no external id' END AS reason FROM {publications}""")
def _(spark, sf_dir):
    return H.poll_range(read(spark, sf_dir, "publications"), 28, today())


@query("snapshots_since", f"SELECT publication_id, day, views FROM ({SNAPSHOTS}) s WHERE day >= DATE '2024-01-20'")
def _(spark, sf_dir):
    return H.snapshots_since(snapshots(spark, sf_dir), F.lit("2024-01-20").cast("date")).select("publication_id", "day", "views")


@query("upsert_unsettled", f"""WITH o AS ({SNAPSHOTS}), n AS (SELECT publication_id, day, views + 5 AS views FROM o WHERE day >= DATE '2024-01-15')
  SELECT o.publication_id, o.day, CASE WHEN n.day IS NULL OR NOT o.partial THEN o.views ELSE n.views END AS views, n.day IS NOT NULL AND o.partial AS written
  FROM o LEFT JOIN n ON n.publication_id = o.publication_id AND n.day = o.day""")
def _(spark, sf_dir):
    old = snapshots(spark, sf_dir)
    new = old.filter("day >= DATE '2024-01-15'").withColumn("views", F.col("views") + 5)
    return H.upsert_unsettled(old, new).select("publication_id", "day", "views", "written")


FOLDED = f"""SELECT publication_id, CAST(sum(views) AS BIGINT) AS views, CAST(sum(likes) AS BIGINT) AS likes, CAST(sum(comments) AS BIGINT) AS comments, count(*) AS days,
  arg_max(average_view_percentage, day) FILTER (WHERE average_view_percentage IS NOT NULL) AS view_percentage FROM ({SNAPSHOTS}) s GROUP BY publication_id"""


@query("fold_snapshots", f"SELECT * REPLACE (round_even(view_percentage, 4) AS view_percentage) FROM ({FOLDED}) f")
def _(spark, sf_dir):
    return H.fold_snapshots(snapshots(spark, sf_dir)).withColumn("view_percentage", pct("view_percentage"))


@query("rollup_publications", f"SELECT publication_id, views, likes, comments, days FROM ({FOLDED}) f ORDER BY views DESC, publication_id")
def _(spark, sf_dir):
    return H.rollup_publications(snapshots(spark, sf_dir)).drop("view_percentage")


@query("insight_totals", f"SELECT CAST(sum(views) AS BIGINT) AS views, count(DISTINCT publication_id) AS publications, count(*) AS snapshots, count(DISTINCT CASE WHEN average_view_percentage IS NOT NULL THEN publication_id END) AS drawable FROM ({SNAPSHOTS}) s")
def _(spark, sf_dir):
    return H.insight_totals(snapshots(spark, sf_dir))


def sub_scores():
    return {k: F.col(k) for k in M.RUBRIC}


TOTAL_SQL = "greatest(least(CAST(round_even((hook / 25.0::DOUBLE * 0.25::DOUBLE + curiosity / 20.0::DOUBLE * 0.20::DOUBLE + standalone / 20.0::DOUBLE * 0.20::DOUBLE + emotion / 15.0::DOUBLE * 0.15::DOUBLE + pacing / 10.0::DOUBLE * 0.10::DOUBLE + shareability / 10.0::DOUBLE * 0.10::DOUBLE) * 100, 0) AS INT), 100), 0)"


@query("total_score", f"SELECT order_id, line, part, source_id, {TOTAL_SQL} AS total FROM {{candidates}}")
def _(spark, sf_dir):
    return read(spark, sf_dir, "candidates").select("order_id", "line", "part", "source_id", M.total_score(sub_scores()).alias("total"))


FACTS = f"""SELECT p.publication_id, c.total AS predicted_score, c.hook, c.curiosity, c.standalone, c.emotion, c.pacing, c.shareability, l.hook AS hook_line,
  c.end_sec - c.start_sec AS duration_sec, p.published_at, [' Tag' || CAST(p.publication_id % 5 AS VARCHAR), 'x'] AS tags,
  CASE WHEN p.publication_id % 4 = 0 THEN '' ELSE 'style' || CAST(p.publication_id % 3 AS VARCHAR) END AS caption_style,
  CASE WHEN p.publication_id % 2 = 0 THEN 'vertical' ELSE 'square' END AS render_profile, f.views, f.view_percentage
  FROM (SELECT * FROM {{publications}} WHERE state = 'PUBLISHED' AND external_id IS NOT NULL) p
  JOIN ({FOLDED}) f ON f.publication_id = p.publication_id
  LEFT JOIN (SELECT * FROM (SELECT *, {TOTAL_SQL} AS total, row_number() OVER (PARTITION BY order_id ORDER BY {TOTAL_SQL} DESC, line, part, source_id) AS rn FROM {{candidates}}) z WHERE rn = 1) c ON c.order_id = p.publication_id
  LEFT JOIN {{first_lines}} l ON l.doc_id = p.publication_id"""


def clip_facts(spark, sf_dir):
    """Published clips joined to their folded snapshots, the best candidate of their source, and a hook line."""
    from pyspark.sql import Window

    published = H.published_only(read(spark, sf_dir, "publications"))
    folded = H.fold_snapshots(snapshots(spark, sf_dir)).select("publication_id", "views", "view_percentage")
    scored = read(spark, sf_dir, "candidates").withColumn("predicted_score", M.total_score(sub_scores()))
    best = Window.partitionBy("order_id").orderBy(F.desc("predicted_score"), "line", "part", "source_id")
    top = scored.withColumn("rn", F.row_number().over(best)).filter("rn = 1").withColumnRenamed("order_id", "publication_id")
    top = top.withColumn("duration_sec", F.col("end_sec") - F.col("start_sec")).withColumnRenamed("hook", "hook_score")
    lines = read(spark, sf_dir, "first_lines").select(F.col("doc_id").alias("publication_id"), "hook")
    p = F.col("publication_id")
    return (
        published.select("publication_id", "published_at").join(folded, "publication_id")
        .join(top.select("publication_id", "predicted_score", "hook_score", *list(M.RUBRIC)[1:], "duration_sec"), "publication_id", "left")
        .join(lines, "publication_id", "left")
        .withColumn("tags", F.array(F.concat(F.lit(" Tag"), (p % 5).cast("string")), F.lit("x")))
        .withColumn("caption_style", F.when(p % 4 == 0, "").otherwise(F.concat(F.lit("style"), (p % 3).cast("string"))))
        .withColumn("render_profile", F.when(p % 2 == 0, "vertical").otherwise("square"))
        .withColumn("retention_at_half", F.lit(None).cast("double"))
    )


@query("build_clip_facts", f"SELECT publication_id, predicted_score, hook_line AS hook, duration_sec, views, round_even(view_percentage, 4) AS view_percentage FROM ({FACTS}) f")
def _(spark, sf_dir):
    return clip_facts(spark, sf_dir).select("publication_id", "predicted_score", "hook", "duration_sec", "views", pct("view_percentage"))


HOOK_SQL = """CASE WHEN trim(coalesce(h, '')) = '' THEN 'NONE' WHEN ends_with(trim(h), '?') OR regexp_extract(lower(trim(h)), '[\\pL\\pN_'']+', 0) IN
  ('who','what','when','where','why','how','which','is','are','can','did','does','do') THEN 'QUESTION'
  WHEN left(trim(h), 1) || right(trim(h), 1) IN ('""', '''''', '“”') THEN 'QUOTE'
  WHEN list_has_any(regexp_extract_all(lower(trim(h)), '[\\pL\\pN_'']+'), ['best','worst','most','least','only','greatest','biggest','fastest','never','always','ever','perfect','incredible','unbelievable']) THEN 'SUPERLATIVE'
  WHEN regexp_matches(trim(h), '[0-9]') THEN 'NUMBER'
  WHEN list_has_any(regexp_extract_all(lower(trim(h)), '[\\pL\\pN_'']+'), ['not','no','never','without','nobody','nothing','cannot']) THEN 'NEGATION' ELSE 'STATEMENT' END"""


def hook_sql(column):
    return HOOK_SQL.replace("(h)", f"({column})").replace("(h,", f"({column},")


@query("hook_type", f"SELECT doc_id, {hook_sql('hook')} AS hook_type FROM {{first_lines}}")
def _(spark, sf_dir):
    return read(spark, sf_dir, "first_lines").select("doc_id", M.hook_type(F.col("hook")).alias("hook_type"))


DURATION_SQL = "CASE WHEN d IS NULL OR d <= 0 THEN NULL WHEN d < 15 THEN '<15s' WHEN d < 30 THEN '15-30s' WHEN d < 45 THEN '30-45s' WHEN d <= 60 THEN '45-60s' ELSE '>60s' END"
BAND_SQL = "CASE WHEN t IS NULL THEN NULL WHEN t < 60 THEN '<60' WHEN t < 70 THEN '60-69' WHEN t < 80 THEN '70-79' WHEN t < 90 THEN '80-89' ELSE '90+' END"


@query("duration_bucket", f"SELECT order_id, line, part, source_id, {DURATION_SQL} AS bucket FROM (SELECT *, end_sec - start_sec - 20 AS d FROM {{candidates}}) c")
def _(spark, sf_dir):
    return read(spark, sf_dir, "candidates").select("order_id", "line", "part", "source_id", M.duration_bucket(F.col("end_sec") - F.col("start_sec") - 20).alias("bucket"))


@query("score_band", f"SELECT band, count(*) AS n FROM (SELECT {BAND_SQL} AS band FROM (SELECT {TOTAL_SQL} + 20 AS t FROM {{candidates}}) c) b GROUP BY band")
def _(spark, sf_dir):
    return read(spark, sf_dir, "candidates").groupBy(M.score_band(M.total_score(sub_scores()) + 20).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("posting_band", "SELECT event_id, lpad(CAST(hour(ts) // 4 * 4 AS VARCHAR), 2, '0') || '-' || lpad(CAST(hour(ts) // 4 * 4 + 4 AS VARCHAR), 2, '0') || ' UTC' AS band FROM {events}")
def _(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", M.posting_band(F.col("ts")).alias("band"))


@query("first_topic", "SELECT item_id, lower(trim(split_part(text, '.', 2))) AS topic FROM {benchmark} WHERE trim(split_part(text, '.', 2)) <> '' UNION ALL SELECT item_id, NULL FROM {benchmark} WHERE trim(split_part(text, '.', 2)) = ''")
def _(spark, sf_dir):
    tags = F.array(F.lit("  "), F.split_part("text", F.lit("."), F.lit(2)))
    return read(spark, sf_dir, "benchmark").select("item_id", M.first_topic(tags).alias("topic"))


BUCKETS = f"""SELECT * FROM (SELECT publication_id, 'HOOK_TYPE' AS kind, nullif({hook_sql('hook_line')}, 'NONE') AS bucket, predicted_score, views, view_percentage FROM ({FACTS}) f
  UNION ALL SELECT publication_id, 'DURATION_BUCKET', {DURATION_SQL.replace(' d ', ' duration_sec ')}, predicted_score, views, view_percentage FROM ({FACTS}) f
  UNION ALL SELECT publication_id, 'SCORE_BAND', {BAND_SQL.replace(' t ', ' predicted_score ')}, predicted_score, views, view_percentage FROM ({FACTS}) f
  UNION ALL SELECT publication_id, 'TOPIC', lower(trim(tags[1])), predicted_score, views, view_percentage FROM ({FACTS}) f
  UNION ALL SELECT publication_id, 'POSTING_HOUR', lpad(CAST(hour(published_at) // 4 * 4 AS VARCHAR), 2, '0') || '-' || lpad(CAST(hour(published_at) // 4 * 4 + 4 AS VARCHAR), 2, '0') || ' UTC', predicted_score, views, view_percentage FROM ({FACTS}) f
  UNION ALL SELECT publication_id, 'CAPTION_STYLE', nullif(caption_style, ''), predicted_score, views, view_percentage FROM ({FACTS}) f
  UNION ALL SELECT publication_id, 'RENDER_PROFILE', nullif(render_profile, ''), predicted_score, views, view_percentage FROM ({FACTS}) f) b WHERE bucket IS NOT NULL"""


@query("bucket_for", f"SELECT publication_id, kind, bucket FROM ({BUCKETS}) b")
def _(spark, sf_dir):
    return C.bucket_for(clip_facts(spark, sf_dir)).select("publication_id", "kind", "bucket")


@query("cohort_summary", f"""SELECT kind, bucket, count(*) AS n, CASE WHEN count(predicted_score) >= 3 THEN round_even(avg(predicted_score), 4) END AS mean_predicted_score,
  CASE WHEN count(views) >= 3 THEN round_even(avg(views), 4) END AS mean_views, CASE WHEN count(view_percentage) >= 3 THEN round_even(round_even(avg(view_percentage), 4), 2) END AS mean_view_percentage,
  CAST(NULL AS DOUBLE) AS mean_retention_at_half FROM ({BUCKETS}) b GROUP BY kind, bucket""")
def _(spark, sf_dir):
    return C.cohort_summary(C.bucket_for(clip_facts(spark, sf_dir))).withColumn("mean_view_percentage", F.bround("mean_view_percentage", 2))


@query("mid_rank", "SELECT o_orderkey, (rank() OVER (ORDER BY CAST(o_totalprice AS BIGINT) % 1000) + (count(*) OVER (PARTITION BY CAST(o_totalprice AS BIGINT) % 1000) - 1) / 2.0)::DOUBLE AS rank FROM {orders}")
def _(spark, sf_dir):
    v = read(spark, sf_dir, "orders").select("o_orderkey", (F.bround("o_totalprice", 0).cast("long") % 1000).alias("v"))
    return C.mid_rank(v, "v").select("o_orderkey", "rank")


@query("pearson", "SELECT l_returnflag, round_even(corr(l_quantity, l_extendedprice), 4) AS r FROM {lineitem} GROUP BY l_returnflag")
def _(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.bround(C.pearson(F.col("l_quantity"), F.col("l_extendedprice")), 4).alias("r"))


RANKED = "SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM"


@query("spearman", f"SELECT round_even(corr(rx, ry), 4) AS r FROM ({RANKED} (SELECT l_quantity AS x, l_discount AS y FROM {{lineitem}}) p) q")
def _(spark, sf_dir):
    p = read(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))
    both = C.mid_rank(C.mid_rank(p, "x", (), "rx"), "y", (), "ry")
    return both.agg(F.bround(C.pearson(F.col("rx"), F.col("ry")), 4).alias("r"))


def _correlated(outcome):
    return f"""SELECT '{outcome}' AS outcome, count(*) AS n, corr(rx, ry) AS r FROM ({RANKED} (SELECT predicted_score AS x, CAST({outcome} AS DOUBLE) AS y FROM ({FACTS}) f WHERE predicted_score IS NOT NULL AND {outcome} IS NOT NULL) p) q"""


@query("correlate", f"""SELECT outcome, n, round_even(r, 4) AS coefficient, round_even(tanh(atanh(r) - 1.96 * 1.06 / sqrt(n - 3)), 4) AS ci_low,
  round_even(tanh(atanh(r) + 1.96 * 1.06 / sqrt(n - 3)), 4) AS ci_high FROM ({_correlated('views')} UNION ALL {_correlated('view_percentage')}) c WHERE n > 0""")
def _(spark, sf_dir):
    return C.correlate(clip_facts(spark, sf_dir), "predicted_score", ["views", "view_percentage"]).drop("interpretation")


@query("interpretation", f"""SELECT outcome, n, CASE WHEN n < 2 THEN printf('n=%d: nothing to correlate.', n) WHEN r IS NULL OR isnan(r) THEN 'Undefined: a side has no variation.' WHEN n < {M.MIN_CONCLUSION} THEN printf('n=%d: too few for a conclusion.', n)
  WHEN abs(r) >= 1 THEN printf('n=%d: no interval, no conclusion.', n) WHEN low <= 0 AND high >= 0 THEN printf('[%.2f, %.2f] contains zero: no relation shown.', low, high)
  ELSE printf('A %s relation, %s, [%.2f, %.2f].', CASE WHEN abs(r) < 0.3 THEN 'weak' WHEN abs(r) < 0.6 THEN 'moderate' ELSE 'strong' END, CASE WHEN r > 0 THEN 'higher' ELSE 'lower' END, low, high) END AS interpretation
  FROM (SELECT *, CASE WHEN n > 3 AND abs(r) < 1 THEN tanh(atanh(r) - 1.96 * 1.06 / sqrt(n - 3)) END AS low, CASE WHEN n > 3 AND abs(r) < 1 THEN tanh(atanh(r) + 1.96 * 1.06 / sqrt(n - 3)) END AS high
  FROM ({_correlated('views')} UNION ALL {_correlated('view_percentage')}) c WHERE n > 0) i""")
def _(spark, sf_dir):
    return C.correlate(clip_facts(spark, sf_dir), "predicted_score", ["views", "view_percentage"]).select("outcome", "n", "interpretation")


@query("fisher_interval", """SELECT l_suppkey, n, round_even(tanh(atanh(r) - 1.96 * 1.06 / sqrt(n - 3)), 4) AS low, round_even(tanh(atanh(r) + 1.96 * 1.06 / sqrt(n - 3)), 4) AS high
  FROM (SELECT l_suppkey, count(*) AS n, corr(l_quantity, l_extendedprice) AS r FROM {lineitem} GROUP BY l_suppkey) s""")
def _(spark, sf_dir):
    r = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), C.pearson(F.col("l_quantity"), F.col("l_extendedprice")).alias("r"))
    low, high = M.fisher_interval(F.col("r"), F.col("n"))
    return r.select("l_suppkey", "n", F.bround(low, 4).alias("low"), F.bround(high, 4).alias("high"))


@query("fit_weights")
def _(spark, sf_dir):
    scored = read(spark, sf_dir, "candidates").withColumn("y", F.col("pacing") * 2 + F.col("hook") + F.col("line"))
    return C.fit_weights(scored, "y")


def calibrated(spark, sf_dir):
    outcomes, at = ["views", "view_percentage", "retention_at_half"], F.lit("2024-01-31 00:00:00").cast("timestamp")
    return C.calibration_report(clip_facts(spark, sf_dir), outcomes, at, named={"hook": "hook_score"})


@query("calibration_report")
def _(spark, sf_dir):
    return calibrated(spark, sf_dir)


@query("is_partial", "SELECT publication_id, day, date_diff('day', day, DATE '2024-01-30') <= 3 AS partial FROM {metric_daily}")
def _(spark, sf_dir):
    return read(spark, sf_dir, "metric_daily").select("publication_id", "day", M.is_partial(F.col("day"), today()).alias("partial"))


@query("local_day", "SELECT event_id, CAST(timezone('America/Los_Angeles', timezone('UTC', ts)) AS DATE) AS day FROM {events}")
def _(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", M.local_day(F.col("ts")).alias("day"))


@query("usage_daily", """SELECT CAST(g.d AS DATE) AS day, CAST(coalesce(sum(CASE WHEN event_type = 'view' THEN 1 END), 0) AS BIGINT) AS "view", CAST(coalesce(sum(CASE WHEN event_type = 'click' THEN 1 END), 0) AS BIGINT) AS click
  FROM generate_series(TIMESTAMP '2024-01-24', TIMESTAMP '2024-01-30', INTERVAL 1 DAY) g(d) LEFT JOIN {events} e ON CAST(timezone('America/Los_Angeles', timezone('UTC', e.ts)) AS DATE) = CAST(g.d AS DATE) GROUP BY 1""")
def _(spark, sf_dir):
    points = read(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), F.col("ts").alias("at"), F.lit(1).alias("value"))
    return H.usage_daily(points, today(), "America/Los_Angeles", ["view", "click"])


@query("quota_ledger", "SELECT CAST(ts AS DATE) AS day, CAST(sum(event_id % 7) AS BIGINT) AS used, CAST(greatest((1500 - sum(event_id % 7)) // 100, 0) AS BIGINT) AS uploads_left FROM {events} GROUP BY 1")
def _(spark, sf_dir):
    calls = read(spark, sf_dir, "events").select(F.col("ts").alias("at"), (F.col("event_id") % 7).alias("units"))
    return H.quota_ledger(calls, 1500, 100)


@query("iou_1d", "SELECT order_id, line, part, source_id, round_even(CASE WHEN least(end_sec, 320) - greatest(start_sec, 300) <= 0 THEN 0 ELSE (least(end_sec, 320) - greatest(start_sec, 300)) / ((end_sec - start_sec) + 20 - (least(end_sec, 320) - greatest(start_sec, 300))) END, 4) AS iou FROM {candidates}")
def _(spark, sf_dir):
    return read(spark, sf_dir, "candidates").select("order_id", "line", "part", "source_id", F.bround(M.iou_1d(F.col("start_sec"), F.col("end_sec"), F.lit(300.0), F.lit(320.0)), 4).alias("iou"))


@query("timecode", "SELECT p_partkey, CAST(p_size * 37 // 60 AS VARCHAR) || ':' || lpad(CAST(p_size * 37 % 60 AS VARCHAR), 2, '0') || CASE WHEN p_partkey % 10 = 0 THEN '' ELSE '.' || CAST(p_partkey % 10 AS VARCHAR) END AS clock FROM {part}")
def _(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", M.timecode(F.col("p_size") * 37 + (F.col("p_partkey") % 10) / 10).alias("clock"))


@query("views_per_hour", "SELECT ord, round_even(view_count / greatest(age_hours, 1.0), 4) AS rate FROM {video_hits}")
def _(spark, sf_dir):
    return read(spark, sf_dir, "video_hits").select("ord", F.bround(M.views_per_hour(F.col("view_count"), F.col("age_hours")), 4).alias("rate"))


SPEED = "CASE WHEN rate IS NULL THEN 15.0 WHEN rate <= 0 THEN 0.0 ELSE 40.0 * greatest(least((log10(rate) - 1) / 3.5, 1.0), 0.0) END"


@query("score_video", f"""SELECT ord, CAST(round_even(least(100.0, {SPEED} + CASE WHEN age_hours IS NULL THEN 8.0 WHEN age_hours <= 24 THEN 20.0 WHEN age_hours <= 72 THEN 14.0 WHEN age_hours <= 168 THEN 8.0 ELSE 2.0 END
  + CASE WHEN duration_sec IS NULL THEN 12.0 WHEN duration_sec > 1200 THEN 0.0 WHEN duration_sec >= 60 THEN 25.0 WHEN duration_sec >= 20 THEN 15.0 ELSE 5.0 END
  + CASE WHEN coalesce(view_count, 0) > 0 THEN 15.0 * least(1.0, (length(CAST(view_count AS VARCHAR)) - 1) / 7.0) ELSE 0.0 END), 0) AS INT) AS score
  FROM (SELECT *, view_count / greatest(age_hours, 1.0) AS rate FROM {{video_hits}}) v""")
def _(spark, sf_dir):
    return read(spark, sf_dir, "video_hits").select("ord", M.score_video(F.col("view_count"), F.col("age_hours"), F.col("duration_sec"), 1200.0).alias("score"))


@query("strength_velocity", f"SELECT ord, round_even({SPEED.replace('40.0 *', '1.0 *')}, 4) AS strength FROM (SELECT ord, view_count / greatest(age_hours, 1.0) AS rate FROM {{video_hits}}) v WHERE rate IS NOT NULL")
def _(spark, sf_dir):
    rate = M.views_per_hour(F.col("view_count"), F.col("age_hours"))
    return read(spark, sf_dir, "video_hits").filter(rate.isNotNull()).select("ord", F.bround(M.strength_velocity(rate), 4).alias("strength"))


@query("strength_traffic", "SELECT o_orderkey, round_even(greatest(least((log10(o_totalprice) - 3.5) / 3, 1.0), 0.0), 4) AS strength FROM {orders}")
def _(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", F.bround(M.strength_traffic(F.col("o_totalprice")), 4).alias("strength"))


@query("blend_rank", "SELECT ord, CAST(greatest(least(round_even((CASE WHEN ord % 4 = 0 THEN ord % 101 ELSE 0.6 * (ord % 101) + 4.0 * (ord % 11) END) * CASE WHEN ord % 3 = 0 THEN 0.6 ELSE 1.0 END, 0), 100), 0) AS INT) AS blended FROM {signals}")
def _(spark, sf_dir):
    s = read(spark, sf_dir, "signals")
    o = F.col("ord")
    return s.select("ord", M.blend_rank(o % 101, F.when(o % 4 != 0, o % 11), o % 3 != 0).alias("blended"))
