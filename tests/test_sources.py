from pyspark.sql import functions as F

from lumenreel.sources import contract as C
from lumenreel.sources import feeds as D
from lumenreel.sources import store as S


def test_contract_keeps_declared_fields_and_rejects(spark):
    declared = spark.createDataFrame([], "id long, tags array<struct<name:string>>, n int").schema
    docs = spark.createDataFrame([('{"id": 1, "tags": [{"name": "a", "extra": 1}], "new": 2}',), ('{"id": "x"}',), ('{"n": 3}',), ("nope",), (None,)], "value string")
    rows, rejects = C.read_contract(docs, declared, ("id",))
    assert [(r.id, r.tags[0].name) for r in rows.collect()] == [(1, "a")]
    assert sorted(r.reason for r in rejects.collect()) == ["missing id"] + ["not of the declared types"] * 3
    assert C.unknown_fields(docs, declared).collect()[0].path == "new"
    assert C.field_paths(declared) == {"id", "tags", "tags.name", "n"}


def test_feeds(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    rss = """<rss xmlns:ht="urn:x"><channel><item><title>Big &amp; new</title><ht:approx_traffic>200K+</ht:approx_traffic><pubDate>Mon, 1 Jan 2024 10:00:00 +0000</pubDate></item>
    <item><title>Old</title><pubDate>Mon, 1 Jan 2023 10:00:00 +0000</pubDate></item><item><title>Undated</title></item><item><title> </title></item></channel></rss>"""
    found = D.read_trends_rss(spark.createDataFrame([("r", rss)], "run_id string, value string"), now, 48).collect()
    assert [(r.topic, r.searches) for r in found] == [("Big & new", 200000), ("Undated", 0)]
    atom = """<feed><entry><title>A</title><updated>2024-01-01T10:00:00+00:00</updated><content type="html">&lt;a href="https://x.org/"&gt; &lt;a href="https://youtu.be/abcdefghijk"&gt;</content></entry>
    <entry><title>B</title><content>none</content></entry></feed>"""
    found = D.read_reddit_atom(spark.createDataFrame([("r", atom)], "run_id string, value string"), now, 48).collect()
    assert [(r.topic, round(r.strength, 2), r.video_id) for r in found] == [("A", 0.7, "abcdefghijk"), ("B", 0.15, None)]
    search = spark.createDataFrame([("r", '{"id": "a", "thumbnails": [{"url": "1"}, {"url": "2"}]}'), ("r", '{"id": "b", "live_status": "is_live"}'), ("r", "x")], "run_id string, value string")
    assert [(r.id, r.thumbnail) for r in D.read_search_entries(search).collect()] == [("a", "2")]


def test_feeds_read_as_a_parser_reads_them(spark):
    """Titles, dates and links of odd feeds are those that ElementTree gives."""
    import random
    from xml.etree import ElementTree

    rng = random.Random(2)
    bits = ["plain", " &amp; ", "&#8217;", "&#x2014;", "<![CDATA[<b>&amp;</b>]]>", "<!-- <title>no</title> -->", "é", " ", "&lt;i>", "x" * 150]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 4)))
    feeds = []
    for k in range(120):
        items = "".join(f"<{p}item><{p}title>{text()}</{p}title><q:approx_traffic>{rng.choice(['', '5K+', '1,200'])}</q:approx_traffic><{p}title>{text()}</{p}title></{p}item>" for p in rng.choices(["", "q:"], k=rng.randint(0, 4)))
        feeds.append((k, f'<?xml version="1.0"?><rss xmlns:q="urn:{k}"><channel><title>f</title>{items}</channel></rss>' if k % 7 else f"<rss><channel>{items}<"))
    want, bad = [], []
    for k, body in feeds:
        try:
            root = ElementTree.fromstring(body)
        except ElementTree.ParseError:
            bad.append(k)
            continue
        found = [e for e in root.iter() if e.tag.rsplit("}")[-1] == "item"]
        for at, item in enumerate(found):
            child = lambda name: next((c.text or "" for c in item if c.tag.rsplit("}")[-1] == name), "").strip() or None  # noqa: B023, E731
            if child("title"):
                want.append((k, at, child("title")[:200], f"{child('approx_traffic') or '?'} searches"))
    frame = spark.createDataFrame(feeds, "run_id long, value string")
    got = D.read_trends_rss(frame, F.lit("2024-01-02 00:00:00").cast("timestamp"), 48).select("run_id", "at", "topic", "detail").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 100
    assert sorted(r.run_id for r in D.feed_rejects(frame).collect()) == bad and bad
    assert D.feed_rejects(spark.createDataFrame([(1, None)], "run_id long, value string")).first().reason == "no feed"


def test_reports_decode_by_name(spark):
    daily = '{"columnHeaders": [{"name": "views"}, {"name": "day"}], "rows": [["3", "2024-01-01"], [null, "bad"], [null, "2024-01-02"]]}'
    got = D.read_daily_report(spark.createDataFrame([("p", daily), ("q", "{}")], "publication_id string, value string")).orderBy("day").collect()
    assert [(r.views, r.likes, r.average_view_percentage) for r in got] == [(3, 0, None), (0, 0, None)]
    curve = '{"columnHeaders": [{"name": "audienceWatchRatio"}, {"name": "elapsedVideoTimeRatio"}], "rows": [["1.4", "1.2"], ["-1", "0.5"]]}'
    got = D.read_retention_report(spark.createDataFrame([("p", curve)], "publication_id string, value string")).collect()
    assert [(c.x, c.y) for c in got[0].curve] == [(0.5, 0.0), (1.0, 1.4)]


def test_upsert_keeps_decisions(spark):
    schema = "id long, title string, status string, decided_at string, decided_by string, created_at string, artwork string"
    old = spark.createDataFrame([(1, "a", "KEPT", "x", "me", "c", "art"), (2, "b", "NEW", None, None, "c", None)], schema)
    new = spark.createDataFrame([(1, "A", "NEW", None, None, "d", None), (3, "z", "NEW", None, None, "d", "pic")], schema)
    got = {r.id: r for r in S.upsert_keep_decision(old, new).collect()}
    assert (got[1].title, got[1].status, got[1].created_at, got[1].artwork) == ("A", "KEPT", "c", "art")
    assert got[2].title == "b" and got[3].artwork == "pic"


def test_archive_partition_and_providers(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "job_id string, rank int")
    S.replace_partition(rows, path)
    S.replace_partition(spark.createDataFrame([("a", 9)], "job_id string, rank int"), path)
    assert sorted((r.job_id, r["rank"]) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 2)]
    archive = spark.createDataFrame([("h1", "m", '{"segments": [1]}'), ("h2", "m", "broken")], "content_hash string, model_version string, body string")
    wanted = spark.createDataFrame([("h1", "m"), ("h2", "m"), ("h3", "m")], "content_hash string, model_version string")
    assert sorted(r.content_hash for r in S.archive_misses(wanted, archive, "segments array<int>").collect()) == ["h2", "h3"]

    def broken(spark, request):
        raise ValueError("down")

    found, failed = S.from_providers(spark, {"a": lambda s, r: rows, "b": broken}, {}, "")
    assert found.count() == 2 and failed == {"b": "down"}


def test_answers_are_repaired_once(spark):
    from lumenreel.operators.jobs import call_stats

    declared = spark.createDataFrame([], "hook int, why string").schema
    rows = [(1, '{"hook": 3, "why": "x"}'), (2, "nope"), (3, '{"hook": 99, "why": "y"}'), (4, '{"hook": 4}'), (5, None)]

    def repair(frames):
        for frame in frames:
            said = {2: '{"hook": 5, "why": "now"}', 3: "still no", 4: '{"hook": -1, "why": "z"}'}
            assert set(frame["id"]) <= {2, 3, 4, 5}
            yield frame[frame["id"] < 5].assign(value=lambda f: f["id"].map(said))[["id", "value"]]

    found = C.repaired_responses(spark.createDataFrame(rows, "id long, value string"), declared, ("hook", "why"), {"hook": (0, 10)}, repair)
    got = {r.id: (r.hook, r.why, r.outcome, r.attempts, r.reason) for r in found.collect()}
    assert got == {
        1: (3, "x", "ok", 1, None), 2: (5, "now", "repaired", 2, "not of the declared types"), 3: (None, None, "failed", 2, "not of the declared types"),
        4: (None, None, "failed", 2, "out of range: hook"), 5: (None, None, "failed", 2, "not of the declared types, no repair"),
    }
    totals = call_stats(found.withColumn("seconds", F.lit(1.0)).withColumn("all", F.lit(1)), ["all"]).first()
    assert (totals.ok, totals.repaired, totals.failed, totals.calls) == (1, 1, 3, 5)
    accepted, rejected = C.structured_response(spark.createDataFrame(rows, "id long, value string"), declared, ("hook", "why"), {"hook": (0, 10)})
    assert [r.hook for r in accepted.collect()] == [3] and rejected.count() == 4
