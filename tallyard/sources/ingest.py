"""The whole ingest: raw result, payout and contest files of many meetings become three keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyard.functions import scalars as S
from tallyard.operators.relational import bettable_flag
from tallyard.sources import storage as T

#: Columns of a result file, by position.
RESULT_COLUMNS = ["contest_name", "going", "course", "position", "number", "name_raw", "handler", "second_handler", "carried", "own_weight", "draw", "margin", "running_pos", "finish_time", "odds"]
PAYOUT_COLUMNS = ["date", "contest_no", "contest_name", "pool", "combo", "dividend", "is_refund"]
CONTEST_COLUMNS = ["date", "contest_no", "contest_name", "going", "course", "distance", "contest_class", "prize", "url"]
#: The meeting's number at the end of a file's name.
NUMBER = r"(\d+)\.csv$"
#: Codes may be cut, so participants of one contest may share a code; they then differ by name.
RESULT_KEY, PAYOUT_KEY, CONTEST_KEY = ["contest_id", "participant", "name"], ["contest_id", "pool", "combo"], ["contest_id"]


def _keyed(rows: DataFrame, no) -> DataFrame:
    """rows with d, contest_no and contest_id; those without a date or a number go."""
    rows = rows.withColumns({"d": S.dmy_to_iso(F.col("date")).cast("date"), "contest_no": no}).where("d IS NOT NULL AND contest_no IS NOT NULL")
    return rows.withColumn("contest_id", S.contest_key(F.col("d"), F.col("contest_no")))


def _text(rows: DataFrame, columns: list[str]) -> DataFrame:
    """All of the columns, as strings; those that no file has are empty."""
    return rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in columns])


def contests(raw: DataFrame, payouts: DataFrame) -> DataFrame:
    """A row a contest: its key, distance, prize, venue, and whether it and its meeting have real payouts."""
    rows = _keyed(_text(raw, CONTEST_COLUMNS), S.to_int(F.col("contest_no")))
    rows = rows.withColumns({"distance": S.to_int(F.col("distance")), "prize": S.to_int(F.col("prize")), "venue": S.url_param(F.col("url"), "Racecourse")})
    rows = T.last_of(rows, CONTEST_KEY)
    real = payouts.where("is_refund = 0").select("contest_id")
    out = bettable_flag(rows, real, "contest_id", "d")
    return out.select("date", "d", "contest_no", "contest_id", "contest_name", "going", "course", "distance", "contest_class", "prize", "venue", "is_bettable", "url")


def payouts(raw: DataFrame) -> DataFrame:
    """A row a contest, pool and combination; refunds have no dividend."""
    rows = _keyed(_text(raw, PAYOUT_COLUMNS), S.to_int(F.col("contest_no")))
    refund = F.upper("dividend").contains("REFUND")
    rows = rows.withColumns({"is_refund": refund.cast("int"), "dividend": F.when(~refund, S.to_float(F.col("dividend")))})
    return T.last_of(rows, PAYOUT_KEY).select("date", "d", "contest_no", "contest_id", "pool", "combo", "dividend", "is_refund")


def results(raw: DataFrame, raw_contests: DataFrame, distances: DataFrame, number: str = NUMBER) -> DataFrame:
    """A row a contest and participant, by code and name, that finished.

    Result files have no date: it is the first one of the contest file with the same number. distances: contest_id, distance.
    """
    dates = T.file_key_map(raw_contests.where("trim(date) <> ''"), pattern=number)
    rows = raw.withColumn("file_number", T.file_number(F.col("source"), number)).join(dates.select(F.col("number").alias("file_number"), "date"), "file_number")
    rows = _keyed(rows, S.contest_no(F.col("contest_name")))
    rows = rows.withColumn("parsed", S.parse_name_code(F.col("name_raw")))
    whole = {c: S.to_int(F.col(c)) for c in ("position", "number", "own_weight", "draw")}
    rows = rows.withColumns(whole | {"carried": S.to_float(F.col("carried")), "odds": S.to_float(F.col("odds")), "name": F.col("parsed.name"), "participant": F.col("parsed.code")}).drop("parsed")
    rows = rows.where("position IS NOT NULL AND number IS NOT NULL").join(distances.select("contest_id", "distance"), "contest_id", "left")
    columns = ["date", "d", "contest_no", "contest_id", "contest_name", "going", "course", "distance", "position", "number", "participant", "name", "handler", "second_handler", "carried", "own_weight", "draw", "margin", "running_pos", "finish_time", "odds"]
    return T.last_of(rows.select(*columns, "source"), RESULT_KEY).select(*columns)


def ingest(spark: SparkSession, result_files: str, payout_files: str, contest_files: str, target: str, number: str = NUMBER) -> dict[str, DataFrame]:
    """Reads all files, writes results, payouts and contests under target, and returns them.

    Payout and contest files are headed and may be empty; result files go by position. Rows that can't be keyed, and
    results without a position, are left out; of rows that share a key one stays, the last by file and values.
    """
    done = {}

    def stored(name: str, df: DataFrame) -> DataFrame:
        with T.shuffles_dropped(spark):
            df.write.mode("overwrite").parquet(f"{target}/{name}")
        done[name] = spark.read.schema(df.schema).parquet(f"{target}/{name}")
        return done[name]

    raw_contests = T.read_headed_csv(spark, contest_files).withColumn("source", F.col("_metadata.file_path"))
    paid = stored("payouts", payouts(T.read_headed_csv(spark, payout_files)))
    known = stored("contests", contests(raw_contests, paid))
    stored("results", results(T.read_positional_csv(spark, result_files, RESULT_COLUMNS), raw_contests, known, number))
    return done
