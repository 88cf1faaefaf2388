"""Every query with SQL gives the rows that DuckDB gives; the others run to their end, twice with the same rows."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from lumenreel.plans import registry
from lumenreel.plans.views import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    if isinstance(value, (np.ndarray, list, tuple)):
        return tuple(map(plain, value))
    if value is pd.NaT:
        return None
    return value


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for name in TABLES:
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    relation = duck.sql(registry.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    order = [relation.columns.index(c) for c in columns]
    want = sorted((tuple(plain(row[i]) for i in order) for row in relation.fetchall()), key=repr)
    got = sorted((tuple(plain(row[c]) for c in columns) for row in df.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_gives_the_same_rows_again(spark, name):
    def rows():
        return sorted((tuple(plain(v) for v in row) for row in registry.queries()[name](spark, SF).collect()), key=repr)

    assert rows() == rows()


def check_over(spark, tmp_path, name, tables):
    """A query and its SQL over tables of a test's own: the same rows, which are returned."""
    c = duckdb.connect()
    for table, frame in tables.items():
        frame.coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    df = registry.queries()[name](spark, str(tmp_path))
    got = sorted(tuple(map(plain, row)) for row in df.collect())
    assert got == sorted(tuple(map(plain, row)) for row in c.sql(registry.oracle_sql()[name]).select(*df.columns).fetchall())
    return got


def test_attempts_of_one_time_are_told_by_id(spark, tmp_path):
    order = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    day = pd.Timestamp("1995-01-01").to_pydatetime()
    orders = spark.createDataFrame([(9 - i, i // 3, "P", 1.0, day, "2-HIGH") for i in range(9)], order)
    assert check_over(spark, tmp_path, "live_attempt", {"orders": orders}) == [(0, 7), (1, 4), (2, 1)]


def test_equal_windows_are_equal_in_any_order_of_their_seconds(spark, tmp_path):
    event = "event_id long, ts timestamp, user_id long, event_type string, value double"
    at = lambda quarter: pd.Timestamp("2024-01-01").to_pydatetime() + pd.Timedelta(hours=6 * quarter)
    sums = [(1, [0.3, 0.2, 0.1]), (2, [0.1, 0.2, 0.3])]  # as doubles 0.6 and 0.6000000000000001
    rows = [(i, at(10 * k + i), user, "view", v) for user, order in sums for k, vs in enumerate((order, order[::-1])) for i, v in enumerate(vs)]
    # a later window that is larger by less than its place times a hundred thousandth
    rows += [(0, at(0), 3, "view", 1.0), (1, at(5000), 3, "view", 1.01)]
    assert check_over(spark, tmp_path, "loudest_window", {"events": spark.createDataFrame(rows, event)}) == [(1, 0), (2, 0), (3, 5000)]
