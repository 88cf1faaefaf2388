"""Sinks and store-like updates: upserts that keep human decisions, partition replacement, archives and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.selection import cut

# Columns that people own.
DECIDED = ("status", "decided_at", "decided_by", "created_at")


def upsert_keep_decision(old: DataFrame, new: DataFrame, key: str = "id", artwork: tuple[str, ...] = ("artwork",)) -> DataFrame:
    """New rows over old ones by key; decided columns keep their old values, artwork is kept where the new one is null."""
    o, n = (df.select(F.col(key), F.struct(*[c for c in old.columns if c != key]).alias(name)) for df, name in ((old, "o"), (new, "n")))
    both = o.join(n, key, "full_outer")

    def pick(c: str) -> Column:
        fresh = F.when(F.col("n").isNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
        if c in DECIDED:
            return F.when(F.col("o").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
        return F.coalesce(f"n.{c}", f"o.{c}") if c in artwork else fresh

    return both.select(key, *(pick(c).alias(c) for c in old.columns if c != key))


def replace_partition(df: DataFrame, path: str, column: str = "job_id") -> None:
    """Write a job's rows over those it wrote before; other partitions stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def write_archive(transcripts: DataFrame, path: str) -> None:
    """Transcripts by content hash and model version, in folders by the hash's first two digits."""
    transcripts.withColumn("shard", F.substring("content_hash", 1, 2)).write.mode("append").partitionBy("shard").parquet(path)


def archive_misses(wanted: DataFrame, archive: DataFrame, schema: str) -> DataFrame:
    """Wanted (content_hash, model_version) that the archive lacks; an entry that can't be read is a miss."""
    held = archive.select("content_hash", "model_version", F.from_json("body", schema).alias("b")).filter("b.segments IS NOT NULL")
    return wanted.join(held.drop("b"), ["content_hash", "model_version"], "left_anti")


def update_totals(candidates: DataFrame, totals: DataFrame) -> DataFrame:
    """New totals on current rows and nothing else; totals of rows that are gone drop out."""
    t = totals.select("id", F.col("total").alias("__total"))
    return candidates.join(t, "id", "left").withColumn("total", F.coalesce("__total", "total")).drop("__total")


def annotate_trends(trends: DataFrame, verdicts: DataFrame, columns: tuple[str, ...] = ("angle", "relevance", "worth")) -> DataFrame:
    v = verdicts.select("id", *(F.col(c).alias(f"__{c}") for c in columns))
    joined = trends.join(v, "id", "left")
    return joined.select(*(F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in trends.columns))


def latest_report(reports: DataFrame) -> DataFrame:
    return reports.orderBy(F.desc("generated_at"), F.desc("id")).limit(1)


def run_scan(rows: DataFrame, job: str) -> DataFrame:
    """One run's list in rank order."""
    return rows.filter(F.col("job_id") == job).orderBy("rank")


#: What to bear in mind about some kinds of cohorts.
CAVEATS = {
    "HOOK_TYPE": "Told by English words; a line in another language counts as a statement.",
    "TOPIC": "Only the first tag of a clip; clips without tags are left out.",
    "POSTING_HOUR": "In UTC; the audience's own time isn't known.",
}


def report_markdown(report: DataFrame) -> DataFrame:
    """A calibration report (calibration_report's row) as Markdown: a warning where it can't support a conclusion, correlations with
    their intervals, a table for each kind of cohort with its caveat, the weights in use and fitted, and the notes."""
    number = lambda c, d=2: F.coalesce(F.format_number(c, d), F.lit("–"))
    line = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    table = lambda rows, title: F.concat(F.lit(title), F.array_join(rows, "\n"))
    warning = F.when(F.col("underpowered"), F.format_string("> **No conclusion can be drawn from %d clips.** The figures are shown for completeness.\n\n", F.col("n"))).otherwise("")
    interval = lambda c: F.when(c.ci_low.isNull(), "–").otherwise(F.concat(F.lit("["), number(c.ci_low), F.lit(", "), number(c.ci_high), F.lit("]")))
    pairs = F.transform("correlations", lambda c: line(c.outcome, c.n.cast("string"), number(c.coefficient), interval(c), F.coalesce(c.interpretation, F.lit("–"))))
    kinds = F.array_sort(F.array_distinct(F.transform("cohorts", lambda c: c.kind)))
    caveat = lambda kind: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in CAVEATS.items() for x in pair)), kind), F.lit(""))
    rows = lambda kind: F.transform(F.filter("cohorts", lambda c: c.kind == kind), lambda c: line(c.bucket, c.n.cast("string"), number(c.mean_predicted_score, 1), number(c.mean_views, 1), number(c.mean_view_percentage, 1), number(c.mean_retention_at_half, 3)))
    parts = F.transform(kinds, lambda k: F.concat(F.lit("### "), k, F.when(caveat(k) != "", F.concat(F.lit("\n\n*"), caveat(k), F.lit("*"))).otherwise(""), F.lit("\n\n| bucket | n | score | views | % viewed | at half |\n|-|-|-|-|-|-|\n"), F.array_join(rows(k), "\n")))
    cohorts = F.when(F.size(kinds) > 0, F.array_join(parts, "\n\n")).otherwise("Nothing to break down.")
    names = F.array_sort(F.map_keys("baseline_weights"))
    weights = lambda label, m: F.when(m.isNotNull(), F.concat(F.lit(f"| {label} | "), F.array_join(F.transform(names, lambda k: number(F.element_at(m, k), 3)), " | "), F.lit(" |\n"))).otherwise("")
    head = F.concat(F.lit("| | "), F.array_join(names, " | "), F.lit(" |\n|"), F.repeat(F.lit("-|"), F.size(names) + 1), F.lit("\n"))
    notes = F.array_join(F.transform("notes", lambda x: F.concat(F.lit("- "), x)), "\n")
    return report.select(F.concat(
        F.date_format("generated_at", "'# Calibration, 'yyyy-MM-dd"), F.format_string("\n\n%d publications, %d days.\n\n", F.col("n"), F.col("window_days")), warning,
        table(pairs, "## Score and outcome\n\n| outcome | n | r | 95% | reading |\n|-|-|-|-|-|\n"), F.lit("\n\n## Cohorts\n\n"), cohorts,
        F.lit("\n\n## Weights\n\n"), head, weights("in use", F.col("baseline_weights")), weights("fitted", F.col("fitted_weights")), F.lit("\n## Notes\n\n"), notes, F.lit("\n"),
    ).alias("markdown"))


def from_providers(spark: SparkSession, providers: dict, request: dict, schema: str) -> tuple[DataFrame, dict[str, str]]:
    """Signals of all providers and why any failed; all failing is an error. A provider is a function
    (spark, request) -> DataFrame. Each one's result is written as it is asked, so one that fails while it runs
    doesn't stop the rest either."""
    found, failed = [], {}
    for name, provider in providers.items():
        try:
            found.append(cut(provider(spark, request)))
        except Exception as error:  # a provider is the user's code; one failing doesn't stop the rest
            failed[name] = str(error)
    if not found:
        raise RuntimeError(f"no provider answered: {failed}")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, failed


def with_finder(topics: DataFrame, finder, schema: str) -> DataFrame:
    """A user's finder, proposer or curator over Arrow-fed pandas batches."""
    return topics.mapInPandas(finder, schema)


def brief_defaults(options: DataFrame, limit: int = 5) -> DataFrame:
    """Options filled in: swapped bounds put right, blanks as null, a limit."""
    low, high = F.coalesce("min_sec", F.lit(15.0)), F.coalesce("max_sec", F.lit(75.0))
    return options.select("id", F.least(low, high).alias("min_sec"), F.greatest(low, high).alias("max_sec"), F.nullif(F.trim("theme"), F.lit("")).alias("theme"), F.coalesce("limit", F.lit(limit)).alias("limit"))
