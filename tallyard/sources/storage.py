"""Sources and sinks: positional and headed CSV, Parquet tables with keys, partition replacement, materialised features."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a folder of our own under a
    local master; on a cluster it has to be set, as other machines would not see such a folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is unset; with master {master} it must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallyard-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def workspace(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; nothing is ever written twice to one path."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """What is written within gives its shuffle files back when it is done, not when the driver's garbage is collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def settle(df: DataFrame, tag: str) -> DataFrame:
    """df through Parquet in the shared folder: the plan starts anew and lost executors cost nothing."""
    spark, path = df.sparkSession, workspace(df.sparkSession, tag)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def drop(spark: SparkSession, *stored: DataFrame | str) -> None:
    """Deletes what `settle` stored of these tables, or paths of `workspace`, when nothing will read them any more."""
    for x in stored:
        path = spark._jvm.org.apache.hadoop.fs.Path(x if isinstance(x, str) else x._settled_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _strings(names: list[str]) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def read_positional_csv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Files without names, columns by position, all strings, blanks kept as ''; each file's first line is skipped.
    The file's name comes along as source."""
    rows = spark.read.schema(_strings(names)).option("header", True).option("enforceSchema", True).option("nullValue", "\x00").option("emptyValue", "").csv(path)
    return rows.fillna("").withColumn("source", F.col("_metadata.file_path"))


def read_headed_csv(spark: SparkSession, path: str) -> DataFrame:
    """Files with a header line, all strings; empty files give no rows, rows that don't fit are kept with nulls."""
    return spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_csv_wide(spark: SparkSession, path: str, names: list[str], width: int) -> DataFrame:
    """Columns renamed by position; those beyond the names are extra_col_0, extra_col_1, ..."""
    return read_positional_csv(spark, path, names + [f"extra_col_{k}" for k in range(max(0, width - len(names)))])


def file_number(source: Column, pattern: str = r"(\d+)[^/\d]*$") -> Column:
    """The number in a file's path."""
    return F.regexp_extract(source, pattern, 1).try_cast("int")


def file_key_map(df: DataFrame, source: str = "source", value: str = "date", pattern: str = r"(\d+)[^/\d]*$") -> DataFrame:
    """number, value: the number in each file's path and the first of its values."""
    return df.groupBy(file_number(F.col(source), pattern).alias("number")).agg(F.min(value).alias(value))


def read_sql(spark: SparkSession, path: str, cols: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*cols) if cols else df


def entries_of(df: DataFrame, contest_id, contest: str = "contest", position: str = "position") -> DataFrame:
    """One contest in the order of its positions; the filter reaches the scan."""
    return df.where(F.col(contest) == contest_id).orderBy(position)


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n of every key that more than one row has: none where the constraint holds."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def last_of(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows that share a key the last by all columns; copies meet before the shuffle."""
    last = df.groupBy(*keys).agg(F.max(F.struct(*[c for c in df.columns if c not in keys])).alias("_last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in df.columns])


def write_table(df: DataFrame, path: str, keys: list[str], partition_by: list[str] | None = None) -> None:
    """Replaces the table; of rows that share a key the last by all columns stays."""
    writer = last_of(df, keys).write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def replace_partition(df: DataFrame, path: str, key: str, contest: str = "contest", min_contests: int = 5) -> None:
    """Replaces those partitions of the table that df has, but for those with fewer than min_contests contests."""
    enough = df.groupBy(key).agg(F.count_distinct(contest).alias("_n")).where(F.col("_n") >= min_contests).select(key)
    df.join(enough, key, "left_semi").select(*df.columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def append_meetings(df: DataFrame, path: str, meeting: str, number: str = "number", contest: str = "contest", min_contests: int = 5) -> None:
    """Adds df's meetings to the table of partitions by number: meetings that the table knows replace theirs, new ones get
    the numbers after the largest, in the order of meeting. Those with fewer than min_contests contests are left out."""
    spark = df.sparkSession
    enough = df.groupBy(meeting).agg(F.count_distinct(contest).alias("_n")).where(F.col("_n") >= min_contests).select(meeting)
    known = spark.read.parquet(path).select(meeting, F.col(number).cast("int").alias(number)).distinct()
    most = known.agg(F.coalesce(F.max(number), F.lit(0))).first()[0]
    new = enough.join(known, meeting, "left_anti").withColumn(number, (F.row_number().over(Window.orderBy(meeting)) + most).cast("int"))  # a row a meeting
    numbers = settle(known.join(enough, meeting, "left_semi").unionByName(new), "numbers")
    out = df.drop(number).join(numbers, meeting)
    settle(out, "meetings").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(number).parquet(path)


def catalogue(tables: dict[str, DataFrame]) -> DataFrame:
    """table, column, position, type, n_rows, n_values (not null) of every column, one scan a table."""
    each = []
    for name, df in tables.items():
        counts = df.agg(F.count("*").alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(f"_c{k}") for k, c in enumerate(df.columns)])
        rows = [F.struct(F.lit(name).alias("table"), F.lit(c).alias("column"), F.lit(k + 1).alias("position"), F.lit(t).alias("type"), F.col("_rows").alias("n_rows"), F.col(f"_c{k}").alias("n_values")) for k, (c, t) in enumerate(df.dtypes)]
        each.append(counts.select(F.explode(F.array(*rows)).alias("x")).select("x.*"))
    return reduce(DataFrame.unionByName, each)


def materialise_features(df: DataFrame, path: str, horizon: str, rebuild: bool = False, d: str = "d", by: str = "season") -> DataFrame:
    """df up to the horizon, computed once under a path of that horizon and read from there, by season."""
    spark, place = df.sparkSession, f"{path}/until-{horizon}"
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
    if rebuild or not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        df.where(F.col(d) <= F.lit(horizon).cast("date")).write.mode("overwrite").partitionBy(by).parquet(place)
    return spark.read.parquet(place)


def read_lines(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """One value a line, or, with names, values between tabs."""
    return spark.read.text(path) if names is None else spark.read.schema(_strings(names)).option("sep", "\t").csv(path)


def list_columns(spark: SparkSession) -> DataFrame:
    """table, column, type of every table and view of the catalog's current database."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table string, column string, type string")
