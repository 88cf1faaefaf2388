"""Score against outcome: tie-averaged ranks, correlations, cohort means, and a ridge fit of the weights."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from .selection import cut

MIN_FIT, RIDGE, MIN_BUCKET = 40, 1.0, 3


def value_ranks(counts: DataFrame, value: str, group: tuple[str, ...], out: str) -> DataFrame:
    """Mid-ranks of counted values: counts has group, value and __n, each value once per group.

    Groups and their values are range-partitioned together and written, and each partition's running count of a group starts from the
    group's counts in the partitions before it, so no task sorts all values of a group.
    """
    keys = [*group, value]
    split = cut(counts.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()))
    so_far = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*group, "__part").orderBy(value).rowsBetween(*so_far)
    parts = split.groupBy(*group, "__part").agg(F.sum("__n").alias("__all"))  # a row for each partition that a group reaches into
    earlier = parts.select(*group, "__part", F.coalesce(F.sum("__all").over(Window.partitionBy(*group).orderBy("__part").rowsBetween(*so_far)), F.lit(0)).alias("__before"))
    place = F.col("__before") + F.coalesce(F.sum("__n").over(inside), F.lit(0)) + (F.col("__n") + 1) / 2
    return split.join(earlier, [*group, "__part"]).select(*keys, place.alias(out))


def mid_rank(df: DataFrame, value: str, group: tuple[str, ...] = (), out: str = "rank") -> DataFrame:
    """1-based ranks with ties averaged, per group, nulls unranked. Equal values are counted first, so rows of one value never
    meet."""
    keys = [*group, value]
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return df.join(value_ranks(counts, value, group, out), keys, "left")


def pearson(x: Column, y: Column) -> Column:
    """Linear correlation as an aggregate; null for a constant side or fewer than two pairs."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlate(facts: DataFrame, score: str, outcomes: list[str], spearman: bool = True) -> DataFrame:
    """Per outcome over complete pairs: n, coefficient, 95% interval and what may be said of it.

    Equal pairs are counted first and written, so the facts are read once and rows of one value never meet in a join. Ranks are
    measured from their mean, which is half of one more than their number.
    """
    long = facts.select(score, F.explode(F.array(*(F.struct(F.lit(o).alias("outcome"), F.col(o).cast("double").alias("y")) for o in outcomes))).alias("o"))
    pairs = long.select("o.outcome", F.col(score).cast("double").alias("x"), "o.y").filter("x IS NOT NULL AND y IS NOT NULL")
    counted = cut(pairs.groupBy("outcome", "x", "y").agg(F.count(F.lit(1)).alias("__n")))
    total = counted.groupBy("outcome").agg(F.sum("__n").alias("n"), *(F.sum(F.col("__n") * F.col(c)).alias(f"s{c}") for c in "xy"))
    x, y, n = F.col("x") - F.col("sx") / F.col("n"), F.col("y") - F.col("sy") / F.col("n"), F.col("__n")
    if spearman:
        of = {c: value_ranks(counted.groupBy("outcome", c).agg(F.sum("__n").alias("__n")), c, ("outcome",), f"r{c}") for c in "xy"}
        counted = counted.join(of["x"], ["outcome", "x"]).join(of["y"], ["outcome", "y"])
        x, y = (F.col(r) - (F.col("n") + 1) / 2 for r in ("rx", "ry"))
    joined = counted.join(F.broadcast(total), "outcome")  # a row for each outcome that was asked for
    sums = joined.groupBy("outcome").agg(F.first("n").alias("n"), F.sum(n * x * y).alias("xy"), F.sum(n * x * x).alias("xx"), F.sum(n * y * y).alias("yy"))
    r = F.try_divide(F.col("xy"), F.sqrt(F.col("xx")) * F.sqrt(F.col("yy")))
    found = sums.select("outcome", "n", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)).alias("r")).withColumn("r", F.when(F.col("n") > 1, F.col("r")))
    low, high = M.fisher_interval(F.col("r"), F.col("n"), spearman)
    return found.withColumn("low", low).withColumn("high", high).select(
        "outcome", "n", F.bround("r", 4).alias("coefficient"), F.bround("low", 4).alias("ci_low"), F.bround("high", 4).alias("ci_high"),
        M.interpretation(F.col("r"), F.col("n"), F.col("low"), F.col("high")).alias("interpretation"),
    )


def bucket_for(facts: DataFrame) -> DataFrame:
    """One row per fact and cohort kind with its bucket; unknowable buckets are absent."""
    hook = M.hook_type(F.col("hook"))
    kinds = {
        "HOOK_TYPE": F.when(hook != "NONE", hook), "DURATION_BUCKET": M.duration_bucket(F.col("duration_sec")),
        "SCORE_BAND": M.score_band(F.col("predicted_score")), "TOPIC": M.first_topic(F.col("tags")),
        "POSTING_HOUR": M.posting_band(F.col("published_at")), "CAPTION_STYLE": F.nullif(F.col("caption_style"), F.lit("")),
        "RENDER_PROFILE": F.nullif(F.col("render_profile"), F.lit("")),
    }
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("bucket")) for k, c in kinds.items()))).alias("b")
    return facts.select("*", rows).select(*facts.columns, "b.kind", "b.bucket").filter("bucket IS NOT NULL")


def cohort_summary(bucketed: DataFrame) -> DataFrame:
    """Per kind and bucket: n, and means that are withheld below three contributing values."""
    def mean(c: str) -> Column:
        return F.when(F.count(c) >= MIN_BUCKET, F.bround(F.avg(F.col(c).cast("double")), 4))

    return bucketed.groupBy("kind", "bucket").agg(
        F.count(F.lit(1)).alias("n"), mean("predicted_score").alias("mean_predicted_score"), mean("views").alias("mean_views"),
        mean("view_percentage").alias("mean_view_percentage"), mean("retention_at_half").alias("mean_retention_at_half"),
    )


def fit_weights(facts: DataFrame, outcome: str, minimum: int = MIN_FIT) -> DataFrame:
    """Ridge weights of the six sub-scores against the outcome's ranks, as rows (dimension, weight).

    One pass gives the sums that the 6x6 system needs; only those sums reach the driver. Negative weights are set
    to 0 and the rest sum to 1. No rows below `minimum` complete rows or when no weight is positive.
    """
    dims = list(M.RUBRIC)
    usable = mid_rank(facts.dropna(subset=[*dims, outcome]), outcome, (), "__y")
    x = {d: F.col(d).cast("double") / M.RUBRIC[d][0] for d in dims}
    sums = [F.count(F.lit(1)).alias("n"), F.sum("__y").alias("y"), F.sum(F.col("__y") ** 2).alias("yy")]
    sums += [F.sum(x[d]).alias(f"s_{d}") for d in dims] + [F.sum(x[d] * F.col("__y")).alias(f"y_{d}") for d in dims]
    sums += [F.sum(x[a] * x[b]).alias(f"g_{a}_{b}") for i, a in enumerate(dims) for b in dims[i:]]
    t = usable.agg(*sums).first()
    schema = "dimension string, weight double"
    spark = facts.sparkSession
    if t.n < minimum:
        return spark.createDataFrame([], schema)
    mean = np.array([t[f"s_{d}"] for d in dims]) / t.n
    gram = np.array([[t[f"g_{a}_{b}" if dims.index(a) <= dims.index(b) else f"g_{b}_{a}"] for b in dims] for a in dims]) - t.n * np.outer(mean, mean)
    y_mean = t.y / t.n
    spread = np.sqrt(max(t.yy / t.n - y_mean**2, 0.0)) or 1.0
    right = (np.array([t[f"y_{d}"] for d in dims]) - t.n * mean * y_mean) / spread
    weights = np.clip(np.linalg.solve(gram + RIDGE * np.eye(len(dims)), right), 0, None)
    if weights.sum() <= 0:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame([(d, round(float(w), 4)) for d, w in zip(dims, weights / weights.sum(), strict=True)], schema)


def calibration_report(
    facts: DataFrame, outcomes: list[str], generated_at: Column, baseline: dict[str, float] | None = None, window_days: int = 28, fit_against: str | None = None,
    named: dict[str, str] | None = None, topics: int = 200,
) -> DataFrame:
    """One nested row: the facts' number, correlations, cohorts, the weights in use and those fitted (null where none were), whether
    the sample is too small to conclude from, and notes that say how it came about and why nothing was fitted.

    baseline are the weights in use, the rubric's own by default; fit_against is an outcome, the first by default; named says under
    which columns facts have sub-scores that are called otherwise. Cohorts of a kind beyond the `topics` largest are left out of the
    row, with a note of how many: topics are free text, and one row can't hold them all. cohort_summary has every one.
    """
    spark, target = facts.sparkSession, fit_against or outcomes[0]
    scored = facts
    for dimension, column in (named or {}).items():
        scored = scored.drop(dimension).withColumnRenamed(column, dimension)
    scored = cut(scored.select(*M.RUBRIC, F.col(target).cast("double").alias("outcome")))
    usable = scored.dropna().count()
    fitted = {r.dimension: r.weight for r in fit_weights(scored, "outcome").collect()}
    weights = F.create_map(*(F.lit(x) for pair in (baseline or {d: w for d, (_, w) in M.RUBRIC.items()}).items() for x in pair))
    proposed = F.create_map(*(F.lit(x) for pair in fitted.items() for x in pair)) if fitted else F.lit(None).cast("map<string,double>")
    if fitted:
        why = f"Weights fitted on '{target}' are a proposal: nothing was ranked anew and no setting has changed."
    elif usable < MIN_FIT:
        why = f"No fit: {usable} clips have all sub-scores and '{target}', and it takes {MIN_FIT}."
    else:
        why = f"No fit, though {usable} clips have all sub-scores and '{target}': no dimension goes with it positively. More data won't change that."
    pairs = correlate(facts, "predicted_score", outcomes)
    cohorts = cut(cohort_summary(bucket_for(facts)))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "bucket"))
    shown = cohorts.withColumn("__place", place)
    a = pairs.agg(F.sort_array(F.collect_list(F.struct(*pairs.columns))).alias("correlations"))
    b = shown.agg(
        F.sort_array(F.collect_list(F.when(F.col("__place") <= topics, F.struct(*cohorts.columns)))).alias("cohorts"), F.count_if(F.col("__place") > topics).alias("left_out")
    )
    n = facts.agg(F.count(F.lit(1)).alias("n"))
    notes = F.array_compact(F.array(
        F.format_string(f"%d publications with a settled snapshot, over {window_days} days.", F.col("n")),
        F.lit(f"Correlations are of ranks; below {M.MIN_CONCLUSION} pairs none is a conclusion."),
        F.lit(f"Cohorts of fewer than {MIN_BUCKET} show their count and no means."),
        F.lit(why),
        F.when(F.col("left_out") > 0, F.format_string("%d smaller cohorts aren't listed.", F.col("left_out"))),
    ))
    return n.crossJoin(a).crossJoin(b).select(
        generated_at.alias("generated_at"), "n", F.lit(window_days).alias("window_days"), (F.col("n") < M.MIN_CONCLUSION).alias("underpowered"),
        "correlations", "cohorts", weights.alias("baseline_weights"), proposed.alias("fitted_weights"), notes.alias("notes"),
    )
