"""Domain views over the driver tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: {name} stands for a driver table or another view.
VIEWS = {
    "metric_daily": """SELECT user_id AS publication_id, CAST(ts AS DATE) AS day,
        count(CASE WHEN event_type = 'view' THEN 1 END) AS views, count(CASE WHEN event_type = 'click' THEN 1 END) AS likes,
        count(CASE WHEN event_type = 'signup' THEN 1 END) AS comments, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS shares,
        sum(value) AS minutes, avg(CASE WHEN event_type = 'view' THEN least(value, 100.0) END) AS average_view_percentage
        FROM {events} GROUP BY user_id, CAST(ts AS DATE)""",
    "publications": """SELECT user_id AS publication_id, min(ts) AS published_at, max(event_id) AS clip_id,
        CASE WHEN user_id % 10 = 0 THEN 'PENDING' ELSE 'PUBLISHED' END AS state,
        CASE WHEN user_id % 17 = 0 THEN NULL ELSE concat('ext', CAST(user_id AS VARCHAR(20))) END AS external_id
        FROM {events} GROUP BY user_id""",
    "candidates": """SELECT l_orderkey AS order_id, l_suppkey AS source_id, l_linenumber AS line, l_partkey AS part,
        CAST(l_partkey % 600 AS DOUBLE) AS start_sec, CAST(l_partkey % 600 AS DOUBLE) + 10 + l_quantity AS end_sec,
        CAST(l_partkey % 26 AS INT) AS hook, CAST(l_suppkey % 21 AS INT) AS curiosity, CAST(l_orderkey % 21 AS INT) AS standalone,
        CAST((l_linenumber * 2) % 16 AS INT) AS emotion, CAST(CAST(l_quantity AS BIGINT) % 11 AS INT) AS pacing,
        CAST(l_partkey % 11 AS INT) AS shareability FROM {lineitem}""",
    "clips": """SELECT o_orderkey AS id, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey END AS lineage_id, o_custkey AS owner,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version,
        CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'O' THEN 'PENDING' ELSE 'REJECTED' END AS review,
        CASE WHEN o_orderpriority LIKE '1%' THEN CAST(o_orderdate AS DATE) + 10 END AS superseded_on,
        CAST(o_orderdate AS DATE) AS created_on, o_totalprice AS size_bytes FROM {orders}""",
    "jobs": """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'QUEUED' ELSE 'RUNNING' END AS status,
        o_orderdate AS created_at, CASE WHEN o_orderpriority LIKE '5%' THEN CAST(o_orderdate AS DATE) + 3 END AS not_before,
        CASE WHEN o_orderstatus = 'P' AND o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) + 1 END AS lease_expires,
        CAST(o_orderkey % 4 AS INT) AS attempts, 3 AS max_attempts, o_custkey AS trend_id FROM {orders}""",
    "signals": """SELECT concat(coalesce(source, ''), '-', CAST(CAST(floor(doc_id / 1000.0) AS BIGINT) AS VARCHAR(20))) AS run_id, doc_id AS ord, CASE doc_id % 3 WHEN 0 THEN 'GOOGLE_TRENDS' WHEN 1 THEN 'REDDIT' ELSE 'YOUTUBE' END AS source,
        split_part(text, chr(10), 1) AS topic, CAST(n_chars % 100 AS DOUBLE) / 100 AS strength, CAST(doc_id % 72 AS INT) AS age_hours FROM {documents}""",
    "video_hits": """SELECT CAST(p_partkey % 500 AS VARCHAR(20)) AS external_id, p_brand AS run_id, p_partkey AS ord, p_name AS title,
        CASE WHEN p_partkey % 3 = 0 THEN 'REDDIT' ELSE 'YOUTUBE' END AS via, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_type END AS channel,
        CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_size * 30 AS DOUBLE) END AS duration_sec,
        CASE WHEN p_partkey % 5 = 1 THEN NULL ELSE CAST(p_retailprice * 1000 AS BIGINT) END AS view_count,
        CASE WHEN p_partkey % 5 = 2 THEN NULL ELSE CAST(p_partkey % 400 AS DOUBLE) END AS age_hours FROM {part}""",
    "log_records": """SELECT event_id, concat('app', CAST(user_id % 3 AS VARCHAR(20))) AS app, 'error' AS level, ts,
        concat('request ', CAST(event_id AS VARCHAR(20)), ' failed at ', CAST(CAST(ts AS DATE) AS VARCHAR(20)), 'T10:00:00Z code 0x1f', CAST(user_id % 7 AS VARCHAR(20))) AS message
        FROM {events} WHERE event_type = 'error'""",
    "first_lines": """SELECT doc_id, lang, split_part(text, chr(10), 1) AS hook, length(text) AS n FROM {documents}""",
}


def view_sql(name: str, reference) -> str:
    """The SQL of a view; reference gives the text that stands for a driver table."""
    return expand(f"SELECT * FROM {{{name}}}" if name in TABLES else VIEWS[name], reference)


def expand(sql: str, reference) -> str:
    def named(m: re.Match) -> str:
        return f"({expand(VIEWS[m[1]], reference)})" if m[1] in VIEWS else reference(m[1]) if m[1] in TABLES else m[0]

    return re.sub(r"\{(\w+)\}", named, sql)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or view as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(view_sql(name, lambda t: f"parquet.`{sf_dir}/{t}.parquet`"))


def duck(sql: str) -> str:
    """SQL for DuckDB with {names} of views and tables put in."""
    return expand(sql, lambda t: t)
