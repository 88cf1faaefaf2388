"""Trends: signals to topic clusters, videos merged over sightings, scores and ranks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as T
from .selection import cut

LABEL_ORDER = ("GOOGLE_TRENDS", "YOUTUBE", "REDDIT")


def cluster_signals(signals: DataFrame) -> DataFrame:
    """signals (run_id, ord, topic, strength, ...) with cluster_no: strongest first, each joins the first cluster that
    is about the same thing, whose tokens then grow, or opens one. Signals without topic tokens are left out.

    The rule depends on order, so it is exact only one signal after another: runs are the unit that is spread, and a
    run is as large as its feeds. Inside a run only clusters that share a token are compared.
    """
    tokens = signals.withColumn("tokens", T.topic_tokens(F.col("topic"))).filter(F.size("tokens") > 0)

    def assign(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["strength", "ord"], ascending=[False, True])
        clusters: list[set[str]] = []
        having: dict[str, set[int]] = {}
        out = []
        for listed in rows.tokens:
            own = set(listed)
            home = None
            for at in sorted(set().union(*(having.get(t, set()) for t in own))):
                known = clusters[at]
                shared, smaller = len(own & known), min(len(own), len(known))
                if own == known or shared / len(own | known) >= 0.5 or (smaller >= 2 and shared / smaller >= 0.75):
                    home = at
                    break
            if home is None:
                home = len(clusters)
                clusters.append(set())
            for token in own - clusters[home]:
                having.setdefault(token, set()).add(home)
            clusters[home] |= own
            out.append(home)
        return pd.DataFrame({"run_id": rows.run_id, "ord": rows.ord, "cluster_no": out})

    found = tokens.select("run_id", "ord", "strength", "tokens").groupBy("run_id").applyInPandas(assign, "run_id string, ord long, cluster_no int")
    return tokens.join(found, ["run_id", "ord"])


def cluster_label(source: Column, topic: Column, ord_: Column) -> Column:
    """As an aggregate: the shortest topic of the best source, at most 80 characters."""
    rank = F.when(source == LABEL_ORDER[0], 0).when(source == LABEL_ORDER[1], 1).otherwise(2)
    return F.substring(F.min_by(topic, F.struct(rank, F.length(topic), ord_)), 1, 80)


def cluster_measures(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("run_id", "cluster_no").agg(
        F.count(F.lit(1)).alias("signals"), F.count_distinct("source").alias("sources"), F.max("strength").alias("strength"),
        F.min("age_hours").alias("newest_hours"), cluster_label(F.col("source"), F.col("topic"), F.col("ord")).alias("label"),
        F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens"),
        F.collect_set(F.when(F.col("source") == "YOUTUBE", F.col("topic"))).alias("asked"),
    )


def interest_match(clusters: DataFrame, interests: DataFrame, by: tuple[str, ...] = ("run_id", "cluster_no")) -> DataFrame:
    """Interests whose every token a cluster has, or that a provider was asked for by name: by + (interest)."""
    wanted = interests.withColumn("t", T.topic_tokens(F.col("interest"))).withColumn("size", F.size("t"))
    tokens = clusters.select(*by, F.explode("tokens").alias("token"))
    parts = wanted.select("interest", "size", F.explode("t").alias("token"))
    inside = tokens.join(parts, "token").groupBy(*by, "interest", "size").agg(F.count(F.lit(1)).alias("n")).filter("n = size").select(*by, "interest")
    named = clusters.select(*by, F.explode("asked").alias("interest")).join(interests.select("interest").distinct(), "interest").select(*by, "interest")
    return inside.unionByName(named).distinct()


def score_trend(clusters: DataFrame, lookback: float) -> Column:
    """0 to 100 from sources, strength, newest_hours, n_videos, best_video and matched."""
    agree = F.when(F.col("sources") == 1, 0.3).when(F.col("sources") == 2, 0.7).when(F.col("sources") >= 3, 1.0).otherwise(0.0)
    recent = F.when(F.col("newest_hours").isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - F.greatest(F.col("newest_hours"), F.lit(0)) / max(lookback, 1)))
    total = 30 * agree + 20 * F.col("strength") + 10 * recent + F.when(F.col("n_videos") > 0, 10.0).otherwise(0.0) + F.coalesce("best_video", F.lit(0)) / 10 + F.when(F.col("matched") > 0, 20.0).otherwise(0.0)
    return F.bround(F.least(F.lit(100.0), total), 0).cast("int")


def rank_trends(trends: DataFrame, limit: int, by: str = "run_id") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc("score"), F.desc("strength"), F.length("label"), "cluster_no")
    return trends.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def rerank_curated(trends: DataFrame, by: str = "run_id") -> DataFrame:
    """New places by the blended score, then the old rank; only the rows that move."""
    blended = M.blend_rank(F.col("score"), F.col("relevance"), F.col("worth"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("blended"), "rank"))
    return trends.withColumn("blended", blended).withColumn("place", place).filter("place <> rank")


def dedupe_videos(hits: DataFrame, by: tuple[str, ...] = ("external_id",)) -> DataFrame:
    """One row per video, folded over its sightings in order: the first known value of each field, REDDIT for via once
    any sighting has it, and the title of a later sighting unless the merged one came from YOUTUBE."""
    fields = ["title", "via", "channel", "duration_sec", "view_count", "age_hours"]
    sightings = hits.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ord", *fields))).alias("s"))
    kind = sightings.schema["s"].dataType.elementType.simpleString()  # all fields nullable

    def merge(known, hit):
        blank = lambda c: known[c].isNull() | (known[c] == (F.lit(0) if c != "channel" else F.lit("")))
        values = {
            "ord": known.ord, "title": F.when(known.via == "YOUTUBE", known.title).otherwise(hit.title),
            "via": F.when((known.via == "REDDIT") | (hit.via == "REDDIT"), F.lit("REDDIT")).otherwise(known.via),
            **{c: F.when(blank(c), F.coalesce(hit[c], known[c])).otherwise(known[c]) for c in ("channel", "duration_sec", "view_count")},
            "age_hours": F.coalesce(known.age_hours, hit.age_hours),
        }
        return F.struct(*(v.alias(k) for k, v in values.items())).cast(kind)

    rest = F.slice("s", F.lit(2), F.size("s"))
    return sightings.select(*by, F.aggregate(rest, F.element_at("s", 1).cast(kind), merge).alias("v")).select(*by, *(f"v.{c}" for c in fields))


def trend_pipeline(signals: DataFrame, videos: DataFrame, interests: DataFrame, lookback: float, longest: float, limit: int) -> DataFrame:
    """Signals, clusters, a first score, a shortlist of twice the limit, their videos, the score again, the best. Clusters and
    shortlist are written, as several steps read them."""
    clusters = cut(cluster_measures(cluster_signals(signals)))
    matched = interest_match(clusters, interests).groupBy("run_id", "cluster_no").agg(F.count(F.lit(1)).alias("matched"))
    base = clusters.join(matched, ["run_id", "cluster_no"], "left").withColumn("matched", F.coalesce("matched", F.lit(0)))
    first = base.withColumn("n_videos", F.lit(0)).withColumn("best_video", F.lit(None).cast("int"))
    short = cut(rank_trends(first.withColumn("score", score_trend(first, lookback)), 2 * limit).drop("rank", "score", "n_videos", "best_video"))
    merged = dedupe_videos(videos, ("label_token", "external_id"))
    scored = merged.withColumn("s", M.score_video(F.col("view_count"), F.col("age_hours"), F.col("duration_sec"), longest))
    per_token = scored.groupBy("label_token").agg(F.count(F.lit(1)).alias("n"), F.max("s").alias("s"))
    tokens = short.select("run_id", "cluster_no", F.explode("tokens").alias("label_token"))
    found = tokens.join(per_token, "label_token").groupBy("run_id", "cluster_no").agg(F.sum("n").alias("n_videos"), F.max("s").alias("best_video"))
    full = short.join(found, ["run_id", "cluster_no"], "left").withColumn("n_videos", F.coalesce("n_videos", F.lit(0)))
    return rank_trends(full.withColumn("score", score_trend(full, lookback)), limit).select("run_id", "rank", "label", "score", "strength", "sources", "matched", "n_videos", "best_video")


def research(spark: SparkSession, providers: dict, request: dict, videos: DataFrame, interests: DataFrame, lookback: float, longest: float, limit: int) -> tuple[DataFrame, dict[str, str]]:
    """trend_pipeline over what providers give, and why any of them failed; that all fail is an error."""
    from ..sources.store import from_providers

    signals, failed = from_providers(spark, providers, request, "")
    return trend_pipeline(signals, videos, interests, lookback, longest, limit), failed
