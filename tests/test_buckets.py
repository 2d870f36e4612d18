"""Windows by buckets are windows over whole keys, and no task sees a whole key."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyard.operators import buckets as B
from tallyard.operators import history as H
from tallyard.operators import relational as J


@pytest.fixture(scope="module")
def hot(spark):
    """One handler holds most rows, some have none before, and one is null."""
    rng = random.Random(2)
    rows = [(c, p, dt.date(2000, 1, 1) + dt.timedelta(c // 2), rng.choice([1, 1, 1, 1, 2, None, 3 + c]), rng.choice([None, 1, 2, 3])) for c in range(500) for p in range(rng.randrange(1, 5))]
    return spark.createDataFrame(rows, "contest long, participant long, d date, handler long, position int").repartition(5).cache()


def rows(df, *cols):
    return sorted(map(str, df.select("contest", "participant", *cols).collect()))


@pytest.mark.parametrize("bucket", [None, "floor(contest / 7)", "d"])
def test_same_as_whole_keys(hot, bucket):
    bucket = bucket and F.expr(bucket)
    r = F.round("handler_rate", 9).alias("r")
    for strict in (True, False):
        assert rows(B.handler_rate(hot, n=30, strict=strict, bucket=bucket), r) == rows(H.handler_rate(hot, n=30, strict=strict), r)
    got = B.prior_rate(hot, bucket=bucket)
    want = H.counter(H.prior_wins(H.prior_rate(hot), "handler"), "handler").withColumn("n_before", F.col("n_before").cast("long"))
    names = ["n_before", "prior_wins", F.round("handler_prior_rate", 9).alias("p")]
    assert rows(got, *names) == rows(want, *names)


def test_as_of_same_as_whole_keys(hot):
    history = hot.where("handler IS NOT NULL").groupBy("handler", F.col("d").alias("valid_from")).agg(F.max("contest").alias("v"))
    for bucket in (None, F.col("d")):
        assert rows(B.as_of(hot, history, "handler", "v", -1, bucket=bucket), "v") == rows(J.as_of(hot, history, "handler", "v", -1), "v")


def test_no_task_sees_a_whole_key(spark, hot):
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = B.rolling_mean(hot, "handler", F.col("position"), 5, F.floor(F.col("contest") / 10), "m").select("handler", "m", F.spark_partition_id().alias("p")).collect()
        whole = H.rolling_mean(hot, "handler", "position", 5, "m").select("handler", "m", F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    most = lambda x: max(sum(r["p"] == p for r in x) for p in {r["p"] for r in x})
    assert most(whole) >= 600 and most(out) <= 150


def test_empty(spark, hot):
    assert B.handler_rate(hot.limit(0)).count() == 0 and B.prior_rate(hot.limit(0)).count() == 0
