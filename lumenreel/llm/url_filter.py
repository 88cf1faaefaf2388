"""URL filters by a sort-merge range join.

A rule (host, path) fits its host and all subdomains when the URL's path starts with the rule's. The host's
labels are reversed and joined to the path, which makes a canonical key (org.example + separator + /es/...):
every URL that a rule fits, taken at the rule's host level, has a key that starts with the rule's key, so a
rule is an interval of keys, and intervals nest or are disjoint. A URL takes part once for each level of its
host (www.example.org, example.org, org). Keys and rules are range-partitioned and sorted together and swept
once; the sweep keeps a stack of the rules that are still open. Rules that open in an earlier partition and
reach into a later one are found by looking up those prefixes of each partition's first key that are as long as a
rule of its host.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lower_ascii, table

#: Between host and path; no host contains it, so the keys of different hosts never contain one another.
MARK = "/"
SALTS = 8
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    """From the host's end up to ?, # or the end; empty for null or without ://."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", partitions: int = 0) -> DataFrame:
    """pages with host, path, rule and verdict added (clashing columns are replaced).

    rules has host, path, verdict. The rule with the longest host + path wins, then the one with the longer
    host; of rules with one key a block wins. rule is null and verdict is `default` where no rule fits: a list
    of rules says what to block, so an unlisted URL passes. A null URL, or one without ://, has an empty host
    and path and meets no rule, since every rule has a host. An empty rules table leaves every row at default.
    Repeated rows stay repeated. Rules with a null or empty host are not used.
    """
    spark = pages.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    added = {"host": url_host(F.col(url_col)), "path": url_path(F.col(url_col))}
    known = rules.filter("host <> ''").select(
        lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.col("verdict")
    ).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    urls = pages.select(*(c.alias(k) for k, c in added.items())).filter("host <> ''").distinct()
    labels = F.split("host", r"\.")
    deepest = known.agg(F.max(F.size(labels))).first()[0] or 1  # no rule has more labels, so deeper levels meet none
    level = F.explode(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest))))
    keyed = urls.select("host", "path", labels.alias("labels"), level.alias("level")).select(
        F.concat(_reversed(F.array_join(F.expr("slice(labels, size(labels) - level + 1, level)"), ".")), F.lit(MARK), "path").alias("key"),
        F.lit(1).alias("kind"), "host", "path", F.lit(None).cast("string").alias("verdict"),
    )
    opened = known.select(F.concat(_reversed(F.col("host")), F.lit(MARK), "path").alias("key"), F.lit(0).alias("kind"), "host", "path", "verdict")
    dealt = cut(
        keyed.unionByName(opened).repartitionByRange(n, "key", "kind", "host").withColumn("part", F.spark_partition_id()),
        "url-keys",
    )
    firsts = dealt.groupBy("part").agg(F.min("key").alias("first"))
    at = F.substring_index("key", MARK, 1)  # what stands before the path: a host at one of its levels
    lengths = opened.select(at.alias("at"), F.length("key").alias("upto")).distinct()
    carried = (
        firsts.withColumn("at", F.substring_index("first", MARK, 1))
        .join(lengths, "at")
        .filter(F.col("upto") <= F.length("first"))
        .select("part", F.expr("substring(first, 1, upto)").alias("key"))
        .join(opened.drop("kind"), "key")
        .select("part", "key", F.lit(0).alias("kind"), "host", "path", "verdict")
    )
    # A carried rule may also stand in the partition itself; pushing it twice changes nothing.
    swept = (
        dealt.unionByName(carried)
        .repartition(n, "part")
        .sortWithinPartitions("part", "key", "kind")
        .mapInPandas(_sweep, "host string, path string, rule string, verdict string, host_length int")
    )
    best = swept.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "host_length", "verdict", "rule")).alias("best"))
    salted = best.select("host", "path", "best.rule", "best.verdict", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    rows = pages.select(*kept, *(c.alias(k) for k, c in added.items()), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int").alias("__salt"))
    return rows.join(salted, ["host", "path", "__salt"], "left").select(
        *kept, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )


def _sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One pass over sorted rules and keys; open rules form a stack, the innermost on top."""
    part, stack = None, []
    for frame in frames:
        out = []
        for p, key, kind, host, path, verdict in zip(
            frame.part, frame.key, frame.kind, frame.host, frame.path, frame.verdict, strict=True
        ):
            if p != part:
                part, stack = p, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                stack.append((key, host + path, verdict, len(host)))
            elif stack:
                out.append((host, path, *stack[-1][1:]))
        if out:
            yield pd.DataFrame(out, columns=["host", "path", "rule", "verdict", "host_length"])


def query(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


ORACLE = """
WITH r(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id,
  translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
m AS (SELECT u.page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
  arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY u.page_id)
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM u LEFT JOIN m ON u.page_id = m.page_id
"""
