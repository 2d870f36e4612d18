"""Queries that run streams to their end and return what they left."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyard.plans.analogue import full_entries, table, with_entries
from tallyard.plans.feature_queries import _R1
from tallyard.registry import query
from tallyard.sources.storage import workspace, write_csv
from tallyard.streaming import streams as T

_W = "PARTITION BY user_id ORDER BY ts, event_id"


@query(f"SELECT user_id, event_id, row_number() OVER ({_W}) - 1 AS n_before, round(avg(value) OVER ({_W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 8) AS rolling5, round(avg(value) OVER ({_W} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), 8) AS rolling30, round(coalesce(value - lag(value) OVER ({_W}), 0), 4) AS value_delta FROM events")
def t1_stream_history(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    part = F.floor(F.datediff("ts", F.lit("1970-01-01")) / 8)
    every = e.withColumn("part", part).unionByName(T.closing(e).withColumn("part", part + 1))
    folder, arrivals = T.arrivals(every, "part", "events")
    path, checkpoint = workspace(spark, "history"), workspace(spark, "checkpoint")
    for _ in arrivals:  # each part is a run of its own that goes on where the last one ended
        stream = spark.readStream.schema("user_id long, event_id long, ts timestamp, value double").parquet(f"{folder}/*")
        T.run_to_end(T.stream_history(stream, "1 hour"), path, checkpoint)
    return spark.read.parquet(path).select("user_id", "event_id", "n_before", *[F.round(F.nanvl(c, F.lit(None)), 4 if c == "value_delta" else 8).alias(c) for c in ("rolling5", "rolling30", "value_delta")])


@query(with_entries("SELECT participant, round(rating, 2) AS rating FROM US7", _R1[0]))
def t2_stream_ratings(spark, sf):
    e = full_entries(spark, sf).select("contest", "participant", "position", F.year("d").alias("year"))
    folder, arrivals = T.arrivals(e, "year", "entries")
    states, checkpoint, n = workspace(spark, "states"), workspace(spark, "checkpoint"), 0
    for _ in arrivals:
        T.stream_ratings(spark.readStream.schema(e.schema).parquet(f"{folder}/*"), states, checkpoint)
        n += 1
    return T.rating_state(spark, states, n - 1).select("participant", F.round("rating", 2).alias("rating"))


@query("SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1")
def t3_stream_ingest(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("k"), F.col("o_orderpriority").alias("p"))
    source, path, checkpoint = workspace(spark, "csv"), workspace(spark, "ingested"), workspace(spark, "checkpoint")
    write_csv(o.where("o_orderkey % 2 = 0"), f"{source}/first")
    T.stream_ingest(spark, f"{source}/*", "k string, p string", path, checkpoint)
    write_csv(o.where("o_orderkey % 2 = 1"), f"{source}/second")
    return T.stream_ingest(spark, f"{source}/*", "k string, p string", path, checkpoint).groupBy("p").agg(F.count("*").alias("n"))
