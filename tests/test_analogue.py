"""Contests out of the given tables, against their SQL."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyard.plans import ingest_queries as I
from tallyard.plans.analogue import by_contest, entries, full_entries, with_entries
from tallyard.registry import ORACLES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Two contests; the price of the first, in thousands, is a half of a hundredth whose double lies below it."""
    path = str(tmp_path_factory.mktemp("tables"))
    day = dt.datetime(1995, 3, 2)
    spark.createDataFrame([(1, 154265.0, day, "1-URGENT"), (2, 10.0, day, "5-LOW")], "o_orderkey long, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{path}/orders.parquet")
    lines = [(1, p, 7, k, 5.0 * k, 100.0 * k, 0.01 * k) for k, p in enumerate((0x12340, 0x12341, 33, 44), 1)] + [(2, 33, 8, 1, 4.0, 7.0, 0.02), (1, 33, 9, 5, 1.0, 900.0, 0.05)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double").write.parquet(f"{path}/lineitem.parquet")
    return path


def sql(path: str, text: str) -> list:
    c = duckdb.connect()
    for t in ("orders", "lineitem"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    return sorted(c.sql(text).fetchall(), key=str)


def test_entries_are_those_of_their_sql(spark, tables):
    got = entries(spark, tables)
    assert sorted(map(tuple, got.collect()), key=str) == sql(tables, with_entries(f"SELECT {', '.join(got.columns)} FROM E"))
    assert {r["payout"] for r in got.collect()} == {154.26, 0.01}


def test_entries_meet_once(spark, tables):
    """One shuffle of lines, one of orders."""
    plan = full_entries(spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 or plan.count("Exchange hashpartitioning") <= 2, plan


@pytest.mark.parametrize("name", ["ingest_results", "ingest_payouts", "ingest_contests"])
def test_ingest_keeps_participants_whose_cut_codes_are_one(spark, tables, name):
    """K1234 stands for two participants of the first contest."""
    got = getattr(I, name)(spark, tables)
    assert sorted(map(tuple, got.collect()), key=str) == sql(tables, f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})")
    assert name != "ingest_results" or sorted(r["name"] for r in got.where("participant = 'K1234'").collect()) == ["P74560", "P74561"]


def test_tasks_by_contest_keep_their_size_as_rows_grow(spark):
    for n in (10_000, 80_000):
        x = spark.range(n).select(F.floor(F.col("id") / 4).alias("contest"), "id")
        tasks = by_contest(x, 1000).withColumn("task", F.spark_partition_id())
        assert max(r["count"] for r in tasks.groupBy("task").count().collect()) < 2000
        assert tasks.select("contest", "task").distinct().count() == n // 4 and tasks.select("id").distinct().count() == n
