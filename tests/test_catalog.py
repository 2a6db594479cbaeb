"""Every registered query against its oracle, on the smallest test tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from check import TABLES, compare  # noqa: E402

from __spark_entry__ import SMOKE_DIR, entry, oracle_sql, queries  # noqa: E402
from tidemark.plans.catalog import QUERIES  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(SMOKE_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMOKE_DIR}/{table}.parquet'")
    return connection


def test_every_query_has_an_oracle():
    assert QUERIES.keys() <= oracle_sql().keys() and QUERIES.keys() <= queries().keys()


@pytest.mark.parametrize("name", ["first_order_features", "ab_balance", "ab_by_segment"])
def test_line_items_are_thinned_before_they_are_grouped(spark, name):
    frame = QUERIES[name](spark, SMOKE_DIR)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    grouped = plan[plan.index("max(l_shipdate") :]
    assert grouped.index("LeftSemi") < grouped.index("Relation")


def test_no_query_changes_the_session(spark):
    before = spark.sparkContext.getConf().getAll(), spark.conf.getAll
    for name in ("repeat_rate", "weekly_metrics", "ab_readout"):
        QUERIES[name](spark, SMOKE_DIR)
    assert (spark.sparkContext.getConf().getAll(), spark.conf.getAll) == before


def test_entry(spark):
    assert entry(spark).count() == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, con, name):
    assert compare(spark, con, name, SMOKE_DIR) is None
