"""Contests out of the driver's tables: an order is a contest, its parts are the participants, suppliers the handlers.

entries() and ENTRIES are the same relation for Spark and for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyard.functions.scalars import season_label


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task that works by contest.
ROWS = 500_000


def by_contest(x: DataFrame, rows: int = ROWS) -> DataFrame:
    """x's rows by contest. Sorts and tables of what follows grow with a task's rows, so there are as many partitions as
    keep these at about `rows`, which are not joined again; where the cores alone give as many, Spark chooses."""
    parts = -(-x.count() // rows)  # from the files' footers
    return x.repartition(parts, "contest") if parts > x.sparkSession.sparkContext.defaultParallelism else x.repartition("contest")


def lines(spark: SparkSession, sf_dir: str, *more) -> DataFrame:
    """One row for each contest and participant; more are further aggregates. Rows meet by contest, so that this shuffle
    serves all that is done within a contest."""
    x = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_orderkey": "contest", "l_partkey": "participant"})
    return by_contest(x.select("contest", "participant", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_linenumber")).groupBy("contest", "participant").agg(
        F.min("l_suppkey").alias("handler"), F.max("l_extendedprice").alias("price"), F.min("l_quantity").alias("weight"), F.min("l_discount").alias("discount"), *more
    )


def entries(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """contest, d, participant, handler, price, weight, discount, distance, season, position, odds, priority, payout; with
    draw as one more, that too."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("contest"), F.col("o_orderdate").cast("date").alias("d"), F.floor(F.col("o_totalprice") / 100).cast("int").alias("distance"),
        F.col("o_orderpriority").alias("priority"), (F.round(F.col("o_totalprice") / 1000 * 100) / 100).alias("payout"),  # halves of the double, not of its digits
    )
    w = Window.partitionBy("contest").orderBy(F.desc("price"), "participant")
    e = lines(spark, sf_dir, *[F.min("l_linenumber").alias("draw")] * bool(more)).withColumn("position", F.row_number().over(w)).join(o, "contest")
    return e.select("contest", "d", "participant", "handler", "price", "weight", "discount", "distance", season_label(F.col("d")).alias("season"), "position", (1 + F.col("weight") / 5).alias("odds"), "priority", "payout", *more)


ENTRIES = """
L AS (SELECT l_orderkey AS contest, l_partkey AS participant, min(l_suppkey) AS handler, max(l_extendedprice) AS price, min(l_quantity) AS weight, min(l_discount) AS discount
      FROM lineitem GROUP BY 1, 2),
O AS (SELECT o_orderkey AS contest, CAST(o_orderdate AS DATE) AS d, CAST(floor(o_totalprice / 100) AS INTEGER) AS distance, o_orderpriority AS priority, round(o_totalprice / 1000, 2) AS payout FROM orders),
E AS (SELECT L.contest, d, participant, handler, price, weight, discount, distance,
             CAST(year(d - INTERVAL 8 MONTH) AS VARCHAR) || '/' || CAST(year(d - INTERVAL 8 MONTH) + 1 AS VARCHAR) AS season,
             CAST(row_number() OVER (PARTITION BY L.contest ORDER BY price DESC, participant) AS INTEGER) AS position, 1 + weight / 5 AS odds, priority, payout
      FROM L JOIN O ON L.contest = O.contest)
"""


def with_entries(body: str, more: str = "") -> str:
    """SQL with the entries, and further named relations, in front of body."""
    return f"WITH {ENTRIES}{', ' + more if more else ''} {body}"


def full_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entries with the columns that the feature row takes over; every eleventh participant has no position."""
    w = Window.partitionBy("contest")
    e = entries(spark, sf_dir, "draw")
    e = e.withColumns({"early": F.row_number().over(w.orderBy("weight", "participant")), "late": F.row_number().over(w.orderBy(F.desc("discount"), "participant"))})
    return e.withColumns({
        "contest_no": F.col("contest") % 10, "number": F.col("draw"), "name": F.concat(F.lit("P"), F.col("participant").cast("string")), "second_handler": F.col("participant") % 97, "margin": F.col("weight") / 10,
        "running_pos": F.concat_ws(" ", "early", "late", "position"), "course": F.when(F.col("priority") < "3", 'TURF - "A" Course').otherwise("ALL WEATHER TRACK"), "position": F.when(F.col("participant") % 11 != 0, F.col("position")),
    }).drop("early", "late")


FULL_ENTRIES = """
FE AS (SELECT e.* EXCLUDE (position), CASE WHEN e.participant % 11 <> 0 THEN position END AS position, draw, contest % 10 AS contest_no, 'P' || e.participant AS name, e.participant % 97 AS second_handler, weight / 10 AS margin, position AS place,
         row_number() OVER (PARTITION BY e.contest ORDER BY weight, e.participant) AS early, row_number() OVER (PARTITION BY e.contest ORDER BY discount DESC, e.participant) AS late, CAST(priority < '3' AS INTEGER) AS is_turf
       FROM E e JOIN (SELECT l_orderkey AS c, l_partkey AS p, min(l_linenumber) AS draw FROM lineitem GROUP BY 1, 2) x ON x.c = e.contest AND x.p = e.participant)
"""
