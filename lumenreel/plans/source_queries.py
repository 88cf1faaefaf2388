"""Queries over payload decoding, store-like updates and ports; payloads are derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..functions import metrics as M
from ..operators import calibration as C
from ..operators import selection as S
from ..operators import transcript as R
from ..sources import contract as K
from ..sources import feeds as D
from ..sources import store as P
from .metrics_queries import clip_facts
from .registry import query
from .views import read


@query("read_contract", """SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM {events}""")
def _(spark, sf_dir):
    docs = read(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("event_type").alias("unknown"))).alias("value"))
    rows, _ = K.read_contract(docs, StructType([StructField("event_id", LongType()), StructField("k", IntegerType())]), ("event_id", "k"))
    return rows


@query("read_contract_rejects", "SELECT event_id % 4 AS kind, count(*) AS n FROM {events} WHERE event_id % 4 < 2 GROUP BY 1")
def _(spark, sf_dir):
    e = F.col("event_id")
    docs = read(spark, sf_dir, "events").select(F.when(e % 4 == 0, F.concat(F.lit('{"n": 1, "x": "'), (e % 4).cast("string"), F.lit('"}'))).when(e % 4 == 1, F.concat(F.lit("1 broken "), e.cast("string"))).otherwise(F.to_json(F.struct(e.alias("id")))).alias("value"))
    _, rejects = K.read_contract(docs, StructType([StructField("id", LongType()), StructField("n", IntegerType())]), ("id",))
    return rejects.groupBy(F.when(F.col("reason").startswith("missing"), 0).otherwise(1).cast("long").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("drop_nested_paths", "SELECT p_partkey, p_brand AS brand FROM {part}")
def _(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.struct(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).alias("a"), F.col("p_type").alias("b")).alias("d"))
    return p.select("p_partkey", K.drop_nested_paths(F.col("d"), ["a.size", "b"]).alias("d")).select("p_partkey", F.col("d.a.brand").alias("brand"))


@query("structured_response", "SELECT doc_id FROM {documents} WHERE n_chars % 30 <= 25 AND doc_id % 5 <> 0")
def _(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    answers = d.select(F.when(F.col("doc_id") % 5 == 0, "sorry").otherwise(F.to_json(F.struct("doc_id", (F.col("n_chars") % 30).cast("int").alias("hook")))).alias("value"))
    ok, _ = K.structured_response(answers, StructType([StructField("doc_id", LongType()), StructField("hook", IntegerType())]), ("doc_id", "hook"), {"hook": (0, 25)})
    return ok.select("doc_id")


def _mend(frames):
    """A repair that makes answers of every second reject that says which document it is of."""
    for frame in frames:
        frame = frame[frame["id"] % 2 == 0]
        values = [f'{{"doc_id": {i}, "hook": 7}}' if "range" in reason else "sorry again" for i, reason in zip(frame["id"], frame["reason"], strict=True)]
        yield frame.assign(value=values)[["id", "value"]]


@query(
    "structured_response_repair",
    """SELECT doc_id AS id, CASE WHEN doc_id % 5 <> 0 AND n_chars % 30 <= 25 THEN n_chars % 30 WHEN doc_id % 5 <> 0 AND doc_id % 2 = 0 THEN 7 END AS hook,
    CASE WHEN doc_id % 5 <> 0 AND n_chars % 30 <= 25 THEN 'ok' WHEN doc_id % 5 <> 0 AND doc_id % 2 = 0 THEN 'repaired' ELSE 'failed' END AS outcome, CASE WHEN doc_id % 5 <> 0 AND n_chars % 30 <= 25 THEN 1 ELSE 2 END AS attempts,
    CASE WHEN doc_id % 5 = 0 THEN concat('not of the declared types', CASE WHEN doc_id % 2 <> 0 THEN ', no repair' ELSE '' END) WHEN n_chars % 30 > 25 THEN concat('out of range: hook', CASE WHEN doc_id % 2 <> 0 THEN ', no repair' ELSE '' END) END AS reason FROM {documents}""",
)
def _(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    answers = d.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 == 0, "sorry").otherwise(F.to_json(F.struct("doc_id", (F.col("n_chars") % 30).cast("int").alias("hook")))).alias("value"))
    declared = StructType([StructField("doc_id", LongType()), StructField("hook", IntegerType())])
    return K.repaired_responses(answers, declared, ("doc_id", "hook"), {"hook": (0, 25)}, _mend).drop("doc_id")


@query("transcript_archive", "SELECT DISTINCT conv_id FROM {conversations} WHERE conv_id % 3 <> 0")
def _(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list("turn")).alias("segments"))).alias("body"))
    keyed = c.select("conv_id", F.sha2(F.col("conv_id").cast("string"), 256).alias("content_hash"), F.lit("m1").alias("model_version"), "body")
    held = keyed.filter("conv_id % 3 = 0 OR conv_id % 5 = 0").withColumn("body", F.when(F.col("conv_id") % 3 == 0, F.col("body")).otherwise("broken"))
    return P.archive_misses(keyed, held, "segments array<long>").select("conv_id")


@query("traffic_number", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey * 1000 WHEN 1 THEN o_orderkey WHEN 2 THEN o_orderkey * 1000000 ELSE 0 END AS n FROM {orders}")
def _(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.when(k % 4 == 0, F.concat(k.cast("string"), F.lit("K+"))).when(k % 4 == 1, F.concat(F.format_number(k, 0), F.lit("+"))).when(k % 4 == 2, F.concat(k.cast("string"), F.lit(" m"))).otherwise("many")
    return read(spark, sf_dir, "orders").select("o_orderkey", D.traffic_number(text).alias("n"))


@query("strength_position", "SELECT ord, round_even(0.70::DOUBLE - 0.55::DOUBLE * (row_number() OVER (PARTITION BY run_id ORDER BY ord) - 1) / (count(*) OVER (PARTITION BY run_id) - 1), 4) AS strength FROM {signals}")
def _(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("run_id")
    s = read(spark, sf_dir, "signals").select("ord", (F.row_number().over(w.orderBy("ord")) - 1).alias("p"), F.count(F.lit(1)).over(w).alias("n"))
    return s.select("ord", F.bround(D.strength_position(F.col("p"), F.col("n")), 4).alias("strength"))


@query(
    "read_trends_rss",
    """SELECT CAST(floor(doc_id / 100.0) AS BIGINT) AS run_id, concat('t', doc_id, '’s <b> & ', doc_id % 5) AS topic, CASE WHEN doc_id % 2 = 0 THEN doc_id * 1000 ELSE 0 END AS searches,
    CASE WHEN doc_id % 2 = 0 THEN concat(doc_id, 'K+ searches') ELSE '? searches' END AS detail FROM {documents} WHERE doc_id % 3 <> 0""",
)
def _(spark, sf_dir):
    i = F.col("doc_id")
    n = i.cast("string")
    title = F.concat(F.lit("t<!-- not <title> this -->"), n, F.lit("&#8217;s &lt;b> <![CDATA[& "), (i % 5).cast("string"), F.lit("]]>"))
    item = F.concat(F.lit("<item><title>"), title, F.lit("</title>"), F.when(i % 2 == 0, F.concat(F.lit("<ht:approx_traffic> "), n, F.lit("K+</ht:approx_traffic>"))).otherwise(""), F.when(i % 3 == 0, "<pubDate>Sun, 1 Jan 2023 00:00:00 +0000</pubDate>").when(i % 3 == 1, "<pubDate>Mon, 29 Jan 2024 00:00:00 +0000</pubDate>").otherwise(""), F.lit("<title>second</title></item>"))
    feeds = read(spark, sf_dir, "documents").groupBy(F.floor(i / 100).alias("run_id")).agg(F.concat(F.lit('<?xml version="1.0"?><rss xmlns:ht="urn:x"><channel><title>feed</title>'), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("value"))
    broken = feeds.withColumn("value", F.concat("value", F.lit("<rss>")))
    got = D.read_trends_rss(feeds.unionByName(broken), F.lit("2024-01-30 00:00:00").cast("timestamp"), 48)
    return got.select("run_id", "topic", "searches", "detail")


@query(
    "read_reddit_atom",
    """SELECT CAST(floor(doc_id / 100.0) AS BIGINT) AS run_id, concat('t', doc_id, '—') AS topic, CASE WHEN doc_id % 2 = 0 THEN lpad(CAST(doc_id AS VARCHAR), 11, 'a') END AS video_id,
    concat('https://example.org/', doc_id) AS url FROM {documents}""",
)
def _(spark, sf_dir):
    i = F.col("doc_id")
    n = i.cast("string")
    link = F.when(i % 2 == 0, F.concat(F.lit("&lt;a href=&quot;https://example.org/?a=1&amp;amp;b=2&quot;&gt; &lt;a href=&quot;https://youtu.be/"), F.lpad(n, 11, "a"), F.lit("&quot;&gt;"))).otherwise("x")
    entry = F.concat(F.lit("<a:entry><a:title>t"), n, F.lit('&#8212;</a:title><a:link href="https://example.org/first"/><a:link href="https://example.org/'), n, F.lit('"/><a:content type="html">'), link, F.lit("</a:content></a:entry>"))
    feeds = read(spark, sf_dir, "documents").groupBy(F.floor(i / 100).alias("run_id")).agg(F.concat(F.lit('<a:feed xmlns:a="http://www.w3.org/2005/Atom">'), F.array_join(F.collect_list(entry), ""), F.lit("</a:feed>")).alias("value"))
    return D.read_reddit_atom(feeds, F.lit("2024-01-30 00:00:00").cast("timestamp"), 48).select("run_id", "topic", "video_id", "url")


@query("read_search_entries", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, CAST(p_size AS DOUBLE) AS duration, 'b' AS thumbnail FROM {part} WHERE p_partkey % 5 <> 0")
def _(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    thumbs = F.array(F.struct(F.lit("a").alias("url")), F.struct(F.lit("b").alias("url")))
    body = F.to_json(F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.col("p_size").alias("duration"), F.when(F.col("p_partkey") % 5 == 0, "is_live").alias("live_status"), thumbs.alias("thumbnails")))
    return D.read_search_entries(p.select(F.col("p_brand").alias("run_id"), body.alias("value"))).select("id", "title", "duration", "thumbnail")


@query("read_daily_report", "SELECT publication_id, day, views, likes, CAST(0 AS BIGINT) AS comments, round_even(average_view_percentage, 4) AS average_view_percentage FROM {metric_daily}")
def _(spark, sf_dir):
    m = read(spark, sf_dir, "metric_daily")
    row = F.array(F.col("views").cast("string"), F.col("day").cast("string"), F.col("likes").cast("string"), F.col("average_view_percentage").cast("string"))
    names = F.array(*(F.struct(F.lit(n).alias("name")) for n in ("views", "day", "likes", "averageViewPercentage")))
    reports = m.groupBy("publication_id").agg(F.to_json(F.struct(names.alias("columnHeaders"), F.collect_list(row).alias("rows"))).alias("value"))
    return D.read_daily_report(reports).select("publication_id", "day", "views", "likes", "comments", F.bround("average_view_percentage", 4).alias("average_view_percentage"))


@query("read_retention_report", "SELECT l_suppkey AS publication_id, count(*) AS points, round_even(max(least(l_discount * 12, 1.0)), 4) AS reach FROM {lineitem} GROUP BY 1")
def _(spark, sf_dir):
    x = read(spark, sf_dir, "lineitem")
    row = F.array((F.col("l_discount") * 12).cast("string"), F.col("l_tax").cast("string"))
    names = F.array(*(F.struct(F.lit(n).alias("name")) for n in ("elapsedVideoTimeRatio", "audienceWatchRatio")))
    reports = x.groupBy(F.col("l_suppkey").alias("publication_id")).agg(F.to_json(F.struct(names.alias("columnHeaders"), F.collect_list(row).alias("rows"))).alias("value"))
    return D.read_retention_report(reports).select("publication_id", F.size("curve").cast("long").alias("points"), F.bround(F.array_max(F.transform("curve", lambda p: p.x)), 4).alias("reach"))


@query("import_manifest", "SELECT count(DISTINCT p_name || p_brand) FILTER (WHERE p_partkey % 6 <> 0) AS tracks FROM {part}")
def _(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    t = F.struct(F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 6 != 0, F.col("p_brand")).alias("file"), F.col("p_size").alias("bpm"))
    manifests = p.groupBy(F.floor(F.col("p_partkey") / 100)).agg(F.to_json(F.struct(F.collect_list(t).alias("tracks"))).alias("value"))
    tracks, _ = D.import_manifest(manifests, spark.createDataFrame([], "id string"))
    return tracks.agg(F.count(F.lit(1)).alias("tracks"))


@query("upsert_keep_decision", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 <> 0 THEN p_name || '!' ELSE p_name END AS title, CASE WHEN p_partkey % 4 = 0 AND p_partkey % 3 <> 0 THEN 'NEW' ELSE 'KEPT' END AS status FROM {part}")
def _(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.lit("KEPT").alias("status"), F.lit(None).cast("string").alias("artwork"))
    new = p.filter("id % 3 <> 0").withColumn("title", F.concat("title", F.lit("!"))).withColumn("status", F.lit("NEW"))
    return P.upsert_keep_decision(p.filter("id % 4 <> 0 OR id % 3 = 0"), new).select("id", "title", "status")


@query("update_totals", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_size * 2 ELSE p_size END AS total FROM {part}")
def _(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("total"))
    totals = p.filter("id % 2 = 0").select("id", (F.col("total") * 2).alias("total")).unionByName(p.select((-1 - F.col("id")).alias("id"), "total"))
    return P.update_totals(p, totals)


@query("annotate_trends", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 0 END AS relevance FROM {part}")
def _(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    trends = p.select(F.col("p_partkey").alias("id"), F.lit(0).alias("relevance"))
    return P.annotate_trends(trends, p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("relevance")), ("relevance",))


@query("latest_report", "SELECT o_orderkey AS id FROM {orders} ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def _(spark, sf_dir):
    return P.latest_report(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("generated_at"))).select("id")


@query("trend_scan", "SELECT doc_id FROM {documents} WHERE source = 'src3' ORDER BY n_chars, doc_id")
def _(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("job_id"), F.struct("n_chars", "doc_id").alias("rank"))
    return P.run_scan(d, "src3").select("doc_id")


@query("report_markdown")
def _(spark, sf_dir):
    from .metrics_queries import calibrated

    return P.report_markdown(calibrated(spark, sf_dir))


@query("brief_defaults", "SELECT p_partkey AS id, least(coalesce(CASE WHEN p_partkey % 3 > 0 THEN p_size::DOUBLE END, 15.0), 20.0) AS min_sec, greatest(coalesce(CASE WHEN p_partkey % 3 > 0 THEN p_size::DOUBLE END, 15.0), 20.0) AS max_sec, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS theme FROM {part}")
def _(spark, sf_dir):
    k = F.col("p_partkey")
    o = read(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 3 > 0, F.col("p_size").cast("double")).alias("min_sec"), F.lit(20.0).alias("max_sec"), F.when(k % 2 == 0, F.concat(F.lit(" "), "p_type")).otherwise("  ").alias("theme"), F.lit(None).cast("int").alias("limit"))
    return P.brief_defaults(o).drop("limit")


@query("window_spec", "SELECT p_partkey, greatest(120.0, p_size * 7 + 30.0)::DOUBLE AS width, greatest(30.0, greatest(120.0, p_size * 7 + 30.0) / 4)::DOUBLE AS stride FROM {part}")
def _(spark, sf_dir):
    width, stride = R.window_spec(F.col("p_size") * 7.0)
    return read(spark, sf_dir, "part").select("p_partkey", width.alias("width"), stride.alias("stride"))


@query("segment_budget", "SELECT l_orderkey, round_even(greatest(5.0, least(20.0, 45.0 / count(*))), 4)::DOUBLE AS budget FROM {lineitem} GROUP BY 1")
def _(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bround(S.segment_budget(F.count(F.lit(1)), 45.0, 20.0), 4).alias("budget"))


@query("clamp_window", "SELECT order_id, line, part, source_id, least(end_sec, start_sec + 30) AS \"end\", end_sec - start_sec > 30 AS trimmed FROM {candidates}")
def _(spark, sf_dir):
    c = S.clamp_window(F.col("start_sec"), F.col("end_sec"), F.lit(30.0))
    return read(spark, sf_dir, "candidates").select("order_id", "line", "part", "source_id", c.alias("c")).select("order_id", "line", "part", "source_id", "c.end", "c.trimmed")


@query("rect_overlap", "SELECT p_partkey, CASE WHEN least(x + w, 40) <= greatest(x, 20) OR least(y + h, 30) <= greatest(y, 10) THEN false ELSE (least(x + w, 40) - greatest(x, 20)) * (least(y + h, 30) - greatest(y, 10)) / least(w * h, 400) >= 0.3 END AS overlaps FROM (SELECT p_partkey, p_partkey % 83 AS x, p_partkey % 47 AS y, p_partkey % 29 + 5 AS w, p_partkey % 23 + 5 AS h FROM {part}) r")
def _(spark, sf_dir):
    from ..operators.regions import BOX, regions_of_parts

    r = regions_of_parts(read(spark, sf_dir, "part"))
    box = tuple(F.lit(v) for v in (20.0, 10.0, 20.0, 20.0))
    return r.select(F.col("id").alias("p_partkey"), M.rect_overlap(tuple(F.col(c) for c in BOX), box).alias("overlaps"))


@query("provider_port", "SELECT run_id, count(*) AS n FROM {signals} GROUP BY run_id")
def _(spark, sf_dir):
    s = read(spark, sf_dir, "signals")
    found, _ = P.from_providers(spark, {k: (lambda _, r, k=k: s.filter(F.col("source") == k)) for k in ("GOOGLE_TRENDS", "REDDIT", "YOUTUBE")}, {}, "")
    return found.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


def _propose(frames):
    for frame in frames:
        yield frame.assign(end_sec=frame.start_sec + 20.0)[["source_id", "window_no", "start_sec", "end_sec"]]


@query("proposer_port", "SELECT DISTINCT conv_id AS source_id FROM {conversations}")
def _(spark, sf_dir):
    windows = R.sliding_windows(R.segments_of_words(R.words_of_turns(read(spark, sf_dir, "conversations"))))
    found = P.with_finder(windows.select("source_id", "window_no", "start_sec"), _propose, "source_id long, window_no int, start_sec double, end_sec double")
    return found.select("source_id").distinct()
