"""Decoding feed and report payloads that stand in a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, youtube_id

# Multipliers of abbreviated counts, and the range of strengths by position.
UNITS = {"": 1, "K": 1_000, "M": 1_000_000}
POSITION = (0.15, 0.70)


def traffic_number(text: Column) -> Column:
    """'200K+' as 200000; what can't be read is 0."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), ",", "")
    number = F.nullif(F.regexp_extract(plain, r"(?i)(\d+(?:\.\d+)?)\s*([KM]?)", 1), F.lit("")).cast("double")
    unit = F.upper(F.regexp_extract(plain, r"(?i)(\d+(?:\.\d+)?)\s*([KM]?)", 2))
    return F.coalesce(F.floor(number * F.when(unit == "K", UNITS["K"]).when(unit == "M", UNITS["M"]).otherwise(1)), F.lit(0)).cast("long")


def strength_position(position: Column, total: Column) -> Column:
    """The first of a feed is strongest, the last weakest; a single entry is strongest."""
    low, high = POSITION
    share = F.when(total <= 1, 0.0).otherwise(position / (total - 1))
    return F.lit(high) - (high - low) * F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))


#: Longest topic, and what is read of feeds: elements by local name, wherever their prefix comes from; of repeated ones all.
TOPIC = 200
_ITEM = "struct<title:array<string>,approx_traffic:array<string>,pubDate:array<string>,news_item:array<struct<news_item_url:array<string>>>>"
RSS = f"item array<{_ITEM}>, channel array<struct<item:array<{_ITEM}>>>, _corrupt_record string"
_ENTRY = "struct<title:array<string>,published:array<string>,updated:array<string>,link:array<struct<_href:string>>,thumbnail:array<struct<_url:string>>,content:array<string>>"
ATOM = f"entry array<{_ENTRY}>, _corrupt_record string"


def _parsed(feeds: DataFrame, schema: str) -> DataFrame:
    read = F.from_xml("value", schema, {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "ignoreSurroundingSpaces": "false"})
    return feeds.withColumn("feed", F.when(~_goes_on(F.col("value")), read))


def _goes_on(body: Column) -> Column:
    """Whether anything but comments and white space stands after the end of the first element, which the parser doesn't read."""
    root = F.regexp_extract(body, r"(?s)^(?:\s|<\?.*?\?>|<!--.*?-->|<![^>]*>)*<([^\s/>]+)", 1)
    close = F.concat(F.lit("</"), root, F.lit(">"))
    at = F.instr(body, close)
    rest = F.regexp_replace(F.substr(body, at + F.length(close)), r"(?s)<!--.*?-->|\s", "")
    return F.coalesce((at > 0) & (rest != ""), F.lit(False))


def feed_rejects(feeds: DataFrame, schema: str = RSS) -> DataFrame:
    """Feeds that aren't XML, with the reason; the readers leave them out."""
    bad = F.col("feed").isNull() | F.col("feed._corrupt_record").isNotNull()
    return _parsed(feeds, schema).filter(bad).select("run_id", "value", F.when(F.col("value").isNull(), "no feed").otherwise("not XML").alias("reason"))


def _first(texts: Column) -> Column:
    """The first of an element's occurrences, blank as null."""
    return F.nullif(strip(F.try_element_at(texts, F.lit(1))), F.lit(""))


def _unescaped(text: Column) -> Column:
    """HTML inside a text: the marks that links are written with."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def rfc822(text: Column) -> Column:
    """Feed dates with a numeric zone or one by name; a year of two digits is of this century."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), r"^\w{3},\s*", ""), r"^(\d+ \w{3}) (\d{2}) ", "$1 20$2 ")
    for names, offset in (("GMT|UT|UTC|Z", "+0000"), ("EST", "-0500"), ("EDT", "-0400"), ("CST", "-0600"), ("CDT", "-0500"), ("MST", "-0700"), ("MDT", "-0600"), ("PST", "-0800"), ("PDT", "-0700")):
        plain = F.regexp_replace(plain, rf"\s(?:{names})$", f" {offset}")
    return F.coalesce(F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm Z")))


def read_trends_rss(feeds: DataFrame, now: Column, lookback_hours: int) -> DataFrame:
    """RSS items as (run_id, at, topic, searches, detail, observed_at, url); old items go, undated ones stay, and those without a
    title too go. Items stand in a channel or in the feed itself."""
    items = _parsed(feeds, RSS).select("run_id", F.concat(F.coalesce("feed.item", F.array()), F.flatten(F.filter(F.coalesce("feed.channel.item", F.array()), lambda x: x.isNotNull()))).alias("items"))
    i = items.select("run_id", F.posexplode("items").alias("at", "i"))
    traffic = _first(F.col("i.approx_traffic"))
    rows = i.select(
        "run_id", "at", F.substring(_first(F.col("i.title")), 1, TOPIC).alias("topic"), traffic_number(traffic).alias("searches"), F.concat(F.coalesce(traffic, F.lit("?")), F.lit(" searches")).alias("detail"),
        rfc822(_first(F.col("i.pubDate"))).alias("observed_at"), _first(F.try_element_at("i.news_item", F.lit(1)).news_item_url).alias("url"),
    )
    cutoff = now - F.make_dt_interval(hours=F.lit(lookback_hours))
    return rows.filter(F.col("topic").isNotNull() & (F.col("observed_at").isNull() | (F.col("observed_at") >= cutoff)))


def read_reddit_atom(feeds: DataFrame, now: Column, lookback_hours: int) -> DataFrame:
    """Atom entries as (run_id, at, topic, strength, detail, observed_at, url, thumbnail, video_id): strength from the place in the
    feed, the video from the first link of the content that names one, the last link and thumbnail of the entry."""
    entries = _parsed(feeds, ATOM).select("run_id", F.col("feed.entry").alias("entries"))
    e = entries.select("run_id", F.size("entries").alias("n"), F.posexplode("entries").alias("at", "e"))
    links = F.regexp_extract_all(_unescaped(_first(F.col("e.content"))), F.lit(r'href="([^"]+)"'), F.lit(1))
    video = F.try_element_at(F.filter(F.transform(links, lambda x: youtube_id(x)), lambda v: v.isNotNull()), F.lit(1))
    last = lambda c, name: F.try_element_at(F.filter(F.transform(c, lambda x: x[name]), lambda v: F.coalesce(v, F.lit("")) != ""), F.lit(-1))
    rows = e.select(
        "run_id", "at", F.substring(_first(F.col("e.title")), 1, TOPIC).alias("topic"), strength_position(F.col("at"), F.col("n")).alias("strength"),
        F.concat(F.lit("r/"), F.col("run_id").cast("string"), F.lit(" · #"), (F.col("at") + 1).cast("string"), F.lit(" today")).alias("detail"),
        F.try_to_timestamp(F.coalesce(_first(F.col("e.published")), _first(F.col("e.updated")))).alias("observed_at"),
        last(F.col("e.link"), "_href").alias("url"), last(F.col("e.thumbnail"), "_url").alias("thumbnail"), video.alias("video_id"),
    )
    cutoff = now - F.make_dt_interval(hours=F.lit(lookback_hours))
    return rows.filter(F.col("topic").isNotNull() & (F.col("observed_at").isNull() | (F.col("observed_at") >= cutoff)))


def read_search_entries(entries: DataFrame) -> DataFrame:
    """Flat search JSON as typed rows; live and upcoming entries go, the last thumbnail counts."""
    schema = "id string, title string, channel string, duration double, view_count long, live_status string, thumbnails array<struct<url:string>>"
    d = entries.select("run_id", F.from_json("value", schema).alias("d")).filter("d.id IS NOT NULL")
    live = F.coalesce(F.col("d.live_status").isin("is_live", "is_upcoming"), F.lit(False))
    return d.filter(~live).select("run_id", "d.id", "d.title", "d.channel", "d.duration", "d.view_count", F.try_element_at("d.thumbnails", F.lit(-1)).url.alias("thumbnail"))


REPORT = "columnHeaders array<struct<name:string>>, rows array<array<string>>"


def _report_rows(reports: DataFrame) -> DataFrame:
    """Rows of column-headed reports as maps by column name, never by position."""
    d = reports.select("publication_id", F.from_json("value", REPORT).alias("d")).filter("d.columnHeaders IS NOT NULL")
    row = d.select("publication_id", F.transform("d.columnHeaders", lambda h: h["name"]).alias("names"), F.explode("d.rows").alias("row"))
    # of columns with one name the last counts
    last = lambda n, i: n.isNotNull() & ~F.array_contains(F.slice("names", i + 2, F.size("names")), n)
    paired = row.filter(F.size("names") == F.size("row")).select("publication_id", "names", F.arrays_zip("names", "row").alias("pairs"))
    kept = F.filter("pairs", lambda p, i: last(p["names"], i))
    return paired.select("publication_id", F.map_from_entries(kept).alias("m"))


def read_daily_report(reports: DataFrame) -> DataFrame:
    """Daily rows: bad days go, counters default to 0, averages stay null."""
    m = _report_rows(reports)
    count = lambda k: F.coalesce(F.col("m")[k].try_cast("long"), F.lit(0)).alias(k)
    return m.select("publication_id", F.try_to_date(F.col("m")["day"]).alias("day"), *(count(k) for k in ("views", "likes", "comments", "shares")), F.col("m")["averageViewPercentage"].try_cast("double").alias("average_view_percentage")).filter("day IS NOT NULL")


def read_retention_report(reports: DataFrame) -> DataFrame:
    """Curves in order: elapsed ratio held to 0..1, watch ratio only floored, as above 1 is real."""
    m = _report_rows(reports)
    x, y = F.col("m")["elapsedVideoTimeRatio"].try_cast("double"), F.col("m")["audienceWatchRatio"].try_cast("double")
    rows = m.select("publication_id", F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)).alias("x"), F.greatest(y, F.lit(0.0)).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    return rows.groupBy("publication_id").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("curve"))


def import_manifest(manifests: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tracks, rejects): manifest tracks with defaults and length caps, an id from their content, and whether each is
    new or known; tracks without a title or file are rejected."""
    schema = "tracks array<struct<title:string,artist:string,file:string,mood:string,bpm:int>>"
    t = manifests.select(F.explode(F.from_json("value", schema)["tracks"]).alias("t")).select("t.*")
    good = (F.trim(F.coalesce("title", F.lit(""))) != "") & (F.trim(F.coalesce("file", F.lit(""))) != "")
    rows = t.filter(good).select(F.sha2(F.concat_ws("|", "file", "title"), 256).alias("id"), F.substring(F.trim("title"), 1, 200).alias("title"), F.coalesce("artist", F.lit("Unknown")).alias("artist"), "file", F.coalesce("mood", F.lit("neutral")).alias("mood"), "bpm")
    known = existing.select("id").distinct().withColumn("known", F.lit(True))
    marked = rows.dropDuplicates(["id"]).join(known, "id", "left").withColumn("change", F.when(F.col("known"), "updated").otherwise("added")).drop("known")
    return marked, t.filter(~good)
