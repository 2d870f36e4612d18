"""Queries of the whole ingest: raw files are written out of the given tables, then ingested."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyard.plans.analogue import FULL_ENTRIES, entries, full_entries, table, with_entries
from tallyard.registry import query
from tallyard.sources import ingest as I
from tallyard.sources.storage import drop, settle, shuffles_dropped, workspace

#: Files lie in a folder of each meeting here, as Spark names files itself.
NUMBER = r"meeting=(\d+)/"
#: A meeting is two days' contests, numbered; its file has the first day's date.
_MEETING = "CAST(floor(date_diff('day', DATE '1994-12-31', d) / 2) AS INTEGER)"
_RAW = f"""{FULL_ENTRIES}, ME AS (SELECT contest, {_MEETING} AS meeting, min(d) AS d, min(distance) AS distance, min(payout) AS payout FROM E GROUP BY contest, {_MEETING}),
MN AS (SELECT contest, meeting, distance, payout, d, row_number() OVER (PARTITION BY meeting ORDER BY contest) AS no, min(d) OVER (PARTITION BY meeting) AS day FROM ME),
MK AS (SELECT *, strftime(day, '%Y-%m-%d') || '_R' || no AS contest_id FROM MN)"""


def _numbered(e):
    meetings = e.groupBy("contest", F.floor(F.datediff("d", F.lit("1994-12-31")) / 2).cast("int").alias("meeting")).agg(F.min("d").alias("d"), F.min("distance").alias("distance"), F.min("payout").alias("payout"))
    w = Window.partitionBy("meeting")
    return meetings.withColumns({"no": F.row_number().over(w.orderBy("contest")), "day": F.date_format(F.min("d").over(w), "dd/MM/yyyy")})


def _write(df, path: str, header: list[str] | None = None, *texts) -> None:
    """A headed CSV file a meeting; columns are all but meeting, which names its folder. texts are columns made of df's
    once its rows have met by meeting, so that they are not shuffled."""
    df = df.repartition("meeting")
    df = df.select("meeting", *texts) if texts else df
    names = [c for c in df.columns if c != "meeting"]
    df = df.toDF(*[c if c == "meeting" else dict(zip(names, header or names, strict=True))[c] for c in df.columns])
    with shuffles_dropped(df.sparkSession):
        df.write.partitionBy("meeting").option("header", True).option("emptyValue", "").option("compression", "gzip").csv(path)


def ingested(spark, sf) -> dict:
    """The three tables; every call writes the raw files, ingests them and deletes them."""
    raw = workspace(spark, "raw")
    # Entries are made twice, as they lie by contest then; stored, they would have to meet by contest once more.
    e, m = full_entries(spark, sf), settle(_numbered(entries(spark, sf)), "numbered")
    name = F.concat(F.lit("RACE "), F.col("no").cast("string"), F.lit(" ("), F.col("contest").cast("string"), F.lit(")"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("---"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("draw") == 2, 2).otherwise(1)))  # rows that come twice
    rows = e.withColumn("_", times).join(m.select("contest", "meeting", "no"), "contest").select("meeting", "no", "contest", "course", "position", "number", "name", "participant", "handler", "second_handler", "weight", "draw", "running_pos", "odds")
    _write(
        rows, f"{raw}/races", [str(k) for k in range(len(I.RESULT_COLUMNS))],
        name.alias("n"), F.lit("GOOD"), "course", text("position"), text("number"), F.concat(F.col("name"), F.lit(" (K"), F.lpad(F.hex("participant"), 4, "0"), F.lit(")")), text("handler"), text("second_handler"), text("weight"), F.lit("1100"), text("draw"),
        F.lit("1-1/2"), "running_pos", F.lit("0:57.87"), text("odds"),
    )
    contest = m.select("meeting", F.col("day").alias("date"), F.col("no").alias("contest_no"), name.alias("contest_name"), F.lit("GOOD").alias("going"), F.lit("TURF").alias("course"), "distance", F.lit("Class 4").alias("contest_class"), F.lit("n/a").alias("prize"),
                       F.concat(F.lit("http://x/results?racecourse="), F.when(F.col("meeting") % 2 == 0, "st").otherwise("hv"), F.lit("&RaceNo="), F.col("no").cast("string")).alias("url"))
    _write(contest, f"{raw}/metadata")
    paid = m.where("contest % 5 <> 0").select("meeting", F.col("day").alias("date"), F.col("no").alias("contest_no"), name.alias("contest_name"), F.lit("TRIO").alias("pool"), F.lit("1,2,3").alias("combo"), F.when(F.col("contest") % 7 == 0, "REFUND").otherwise(F.col("payout").cast("string")).alias("dividend"), F.lit("0").alias("is_refund"))
    _write(paid, f"{raw}/dividends")
    tables = I.ingest(spark, f"{raw}/races", f"{raw}/dividends", f"{raw}/metadata", workspace(spark, "ingested"), NUMBER)
    drop(spark, m, raw)  # the tables are stored by now
    return tables


@query(with_entries("SELECT contest_id, day AS d, no AS contest_no, MK.distance, FE.position, draw AS number, name, 'K' || lpad(upper(to_hex(participant)), 4, '0') AS participant, CAST(handler AS VARCHAR) AS handler, weight AS carried, odds, course FROM (SELECT *, CASE WHEN is_turf = 1 THEN 'TURF - \"A\" Course' ELSE 'ALL WEATHER TRACK' END AS course FROM FE) FE JOIN MK ON MK.contest = FE.contest WHERE FE.position IS NOT NULL", _RAW))
def ingest_results(spark, sf):
    return ingested(spark, sf)["results"].select("contest_id", "d", "contest_no", "distance", "position", "number", "name", "participant", "handler", "carried", "odds", "course")


@query(with_entries("SELECT contest_id, day AS d, no AS contest_no, 'TRIO' AS pool, '1,2,3' AS combo, CASE WHEN contest % 7 <> 0 THEN payout END AS dividend, CAST(contest % 7 = 0 AS INTEGER) AS is_refund FROM MK WHERE contest % 5 <> 0", _RAW))
def ingest_payouts(spark, sf):
    return ingested(spark, sf)["payouts"].drop("date")


@query(with_entries("SELECT contest_id, day AS d, no AS contest_no, distance, NULL::INTEGER AS prize, CASE WHEN meeting % 2 = 0 THEN 'ST' ELSE 'HV' END AS venue, CAST(contest % 5 <> 0 AND contest % 7 <> 0 AS INTEGER) AS is_bettable FROM MK", _RAW))
def ingest_contests(spark, sf):
    return ingested(spark, sf)["contests"].select("contest_id", "d", "contest_no", "distance", "prize", "venue", "is_bettable")
