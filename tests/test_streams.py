"""Streams: order within the lateness, forgetting, and states that grow by what changed."""

import datetime as dt

from pyspark.sql import functions as F

from tallyard.operators import ratings as R
from tallyard.streaming import streams as T

SCHEMA = "user_id long, event_id long, ts timestamp, value double"
T0 = dt.datetime(2024, 3, 1, 12)


def minutes(n):
    return T0 + dt.timedelta(minutes=n)


def test_late_events_take_their_place_and_idle_users_start_anew(spark, tmp_path):
    """User 1: an event that is late by less than an hour comes before those that had arrived; one that is later is
    dropped. User 2 stays away for three days and is forgotten after one."""
    batches = [
        [(1, 10, minutes(0), 1.0), (1, 12, minutes(50), 3.0), (2, 20, minutes(0), 7.0)],
        [(1, 11, minutes(20), 2.0), (1, 13, minutes(55), 4.0), (2, 21, minutes(5), 8.0)],
        [(1, 14, minutes(200), 5.0)],
        [(1, 9, minutes(1), 100.0), (1, 15, minutes(210), 6.0)],
        [(3, 30, minutes(2 * 1440), 0.0)],
        [(2, 22, minutes(3 * 1440), 9.0)],
        [(-1, 0, minutes(9 * 1440), 0.0)],
    ]
    source, out, checkpoint = (f"file://{tmp_path}/{d}" for d in ("in", "out", "check"))
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{source}/{k}")
        T.run_to_end(T.stream_history(spark.readStream.schema(SCHEMA).parquet(f"{source}/*"), "1 hour", idle_days=1), out, checkpoint)
    got = {r["event_id"]: (r["n_before"], r["value_delta"], None if r["rolling5"] != r["rolling5"] else r["rolling5"]) for r in spark.read.parquet(out).collect()}
    assert got == {
        10: (0, 0.0, None), 11: (1, 1.0, 1.0), 12: (2, 1.0, 1.5), 13: (3, 1.0, 2.0), 14: (4, 1.0, 2.5), 15: (5, 1.0, 3.0),
        20: (0, 0.0, None), 21: (1, 1.0, 7.0), 22: (0, 0.0, None), 30: (0, 0.0, None),
    }


def test_rating_changes_follow_the_batch_and_can_be_run_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "MERGE", 3)
    schema = "contest long, participant long, position int"
    many = [(c, 2 * c + k, k + 1) for c in range(100) for k in (0, 1)]
    batches = [many, *[[(1000 + b, 0, 1), (1000 + b, b, 2)] for b in range(1, 5)]]
    source, states, checkpoint = (f"file://{tmp_path}/{d}" for d in ("in", "states", "check"))
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/{k}")
        T.stream_ratings(spark.readStream.schema(schema).parquet(f"{source}/*"), states, checkpoint)
    assert [spark.read.parquet(f"{states}/change-{k}").count() for k in range(5)] == [200, 2, 2, 2, 2]
    assert spark.read.parquet(f"{states}/merged-2").count() == 200
    every = spark.createDataFrame([(b, *r) for b, rows in enumerate(batches) for r in rows], "b int, " + schema)
    want = {r["participant"]: r["x"] for r in R.pairwise_elo(every, F.col("b")).groupBy("participant").agg(F.max_by("rating_after", "period").alias("x")).collect()}
    read = lambda: {r["participant"]: round(r["rating"], 9) for r in T.rating_state(spark, states, 4).collect()}
    assert read() == {k: round(v, 9) for k, v in want.items()}
    # A stream that has lost its checkpoint runs all batches again, as one that failed runs its last: files are replaced.
    before = read()
    for k in range(5):
        T.stream_ratings(spark.readStream.schema(schema).parquet(f"{source}/[0-{k}]"), states, f"{checkpoint}-again")
    assert read() == before


def test_state_of_history_is_kept_by_bucket_and_equals_windows(spark, tmp_path):
    """Calls of the state follow the buckets, not the users. Missing values count as events, and not in means; events
    without a user are one group; the session's time zone changes nothing."""
    e = spark.range(6000).selectExpr("IF(id % 100 = 7, NULL, id % 600) AS user_id", "id AS event_id", "timestamp_seconds(1709290000 + CAST(id / 10 AS LONG)) AS ts", "IF(id % 13 = 0, NULL, id % 37 + 0.25D) AS value")
    source, out, checkpoint = (f"file://{tmp_path}/{d}" for d in ("in", "out", "check"))
    zone, kept = spark.conf.get("spark.sql.session.timeZone"), []
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for k, part in enumerate((e.where("event_id < 4000"), e.where("event_id >= 4000").unionByName(T.closing(e)))):
            part.coalesce(1).write.parquet(f"{source}/{k}")
            stream = T.stream_history(spark.readStream.schema(SCHEMA).parquet(f"{source}/*"), "1 hour", buckets=8)
            run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
            run.awaitTermination()
            kept += [s["numRowsTotal"] for p in run.recentProgress for s in p["stateOperators"]]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert 0 < max(kept) < 600
    w = "OVER (PARTITION BY user_id ORDER BY ts, event_id"
    want = e.selectExpr("user_id", "event_id", f"row_number() {w}) - 1 AS n_before", *[f"round(avg(value) {w} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING), 8) AS rolling{k}" for k in (5, 30)], f"coalesce(value - lag(value) {w}), 0D) AS value_delta")
    got = spark.read.parquet(out).select("user_id", "event_id", F.col("n_before").cast("int").alias("n_before"), *[F.round(F.nanvl(c, F.lit(None)), 8).alias(c) for c in ("rolling5", "rolling30")], "value_delta")
    assert got.count() == 6000
    assert want.exceptAll(got).count() == 0
