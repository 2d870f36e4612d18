"""History of keys that hold a large share of all rows: windows over a key's buckets of time in place of the whole key.

bucket is a column that rises with the order of date and contest (a month, a day, a range of contests), such that a key's
rows in one bucket fit a task. What a bucket has to know of the key's earlier ones is carried to it: sums as one row a
bucket, and for the last n rows those rows themselves, at most n a bucket. Results are those of windows over whole keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyard.operators.history import FIRST

ORDER = ("d", "contest", "participant")


def month(d: str = "d") -> Column:
    return F.date_trunc("month", F.col(d)).cast("date")


def _joined(e: DataFrame, carried: DataFrame, key: str, *on: str) -> DataFrame:
    """e with what is carried to its key and bucket; a null key is a key like any other."""
    other = carried.withColumnsRenamed({c: f"{c}__" for c in (key, *on)})
    rule = e[key].eqNullSafe(other[f"{key}__"])
    for c in on:
        rule = rule & (e[c] == other[f"{c}__"])
    return e.join(other, rule).drop(*[f"{c}__" for c in (key, *on)])


def _numbered(e: DataFrame, key: str, bucket: Column) -> tuple[DataFrame, DataFrame]:
    """e with _b (bucket) and _i (place in the key's bucket, from 1); key, _b and _n (the key's rows in earlier buckets)."""
    e = e.withColumn("_b", bucket).withColumn("_i", F.row_number().over(Window.partitionBy(key, "_b").orderBy(*ORDER)))
    sizes = e.groupBy(key, "_b").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(FIRST, -1)  # a row a bucket
    return e, sizes.select(key, "_b", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_n"))


def rolling_mean(e: DataFrame, key: str, value: Column, n: int, bucket: Column, name: str) -> DataFrame:
    """Mean of value over the key's last n rows before each; rows count whether or not they have a value.

    A bucket gets the rows that are among the last n before it. They are found among the last n of each earlier bucket, by
    the places that rows have in their key.
    """
    e, starts = _numbered(e.withColumn("_v", value), key, bucket)
    same = Window.partitionBy(key, "_b")
    tail = e.withColumn("_left", F.count("*").over(same) - F.col("_i")).where(F.col("_left") < n).select(key, "_b", "_i", *ORDER, "_v")
    tail = _joined(tail, starts, key, "_b").select(key, F.col("_b").alias("_from"), *ORDER, "_v", (F.col("_n") + F.col("_i")).alias("_place"))
    near = (F.col("_b") > F.col("_from")) & (F.col("_n") - F.col("_place") < n)
    halo = _joined(tail, starts, key).where(near).select(key, "_b", *ORDER, "_v")
    w = same.orderBy(*ORDER).rowsBetween(-n, -1)
    both = e.drop("_i").withColumn("_own", F.lit(True)).unionByName(halo.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    return both.withColumn(name, F.avg("_v").over(w)).where("_own").drop("_b", "_v", "_own")


def running(e: DataFrame, key: str, values: dict[str, Column], bucket: Column) -> DataFrame:
    """By name, the sum of each value over all of the key's rows before this one; 0 at the first."""
    e = e.withColumn("_b", bucket).withColumns({f"_{c}": v for c, v in values.items()})
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(FIRST, -1)  # a row a bucket
    carried = e.groupBy(key, "_b").agg(*[F.sum(f"_{c}").alias(f"_sum_{c}") for c in values])
    carried = carried.select(key, "_b", *[F.sum(f"_sum_{c}").over(before).alias(f"_old_{c}") for c in values])
    within = Window.partitionBy(key, "_b").orderBy(*ORDER).rowsBetween(FIRST, -1)
    zero = F.lit(0)
    out = e.withColumns({c: F.sum(f"_{c}").over(within) for c in values})
    out = _joined(out, carried, key, "_b")
    return out.withColumns({c: F.coalesce(c, zero) + F.coalesce(f"_old_{c}", zero) for c in values}).drop("_b", *[f"_{c}" for c in values], *[f"_old_{c}" for c in values])


def _wins() -> Column:
    return F.coalesce((F.col("position") == 1).cast("double"), F.lit(0.0))


def handler_rate(e: DataFrame, key: str = "handler", n: int = 30, default: float = 0.083, strict: bool = True, bucket: Column | None = None) -> DataFrame:
    """As `history.handler_rate`."""
    e = rolling_mean(e, key, _wins(), n, month() if bucket is None else bucket, "handler_rate").fillna(default, ["handler_rate"])
    if strict:
        first = Window.partitionBy(key, "d", "contest").orderBy("participant").rowsBetween(FIRST, 0)
        e = e.withColumn("handler_rate", F.first_value("handler_rate").over(first))
    return e


def prior_rate(e: DataFrame, key: str = "handler", default: float = 0.08, bucket: Column | None = None) -> DataFrame:
    """As `history.prior_rate`, with n_before (as `history.counter`) and prior_wins beside it."""
    e = running(e, key, {"n_before": F.lit(1).cast("long"), "prior_wins": _wins().cast("long")}, month() if bucket is None else bucket)
    return e.withColumn(f"{key}_prior_rate", F.coalesce(F.try_divide(F.col("prior_wins").cast("double"), F.col("n_before")), F.lit(default)))


def as_of(e: DataFrame, history: DataFrame, key: str, value: str, default, d: str = "d", valid: str = "valid_from", bucket: Column | None = None) -> DataFrame:
    """As `relational.as_of`: a bucket is told the last value of the key's earlier buckets."""
    kind = history.schema[value].dataType
    marks = e.select(*e.columns, F.lit(0).alias("_kind"), F.lit(None).cast(kind).alias("_v"))
    changes = history.select(F.col(key), F.col(valid).alias(d), F.lit(1).alias("_kind"), F.col(value).alias("_v"))
    both = marks.unionByName(changes, allowMissingColumns=True).withColumn("_b", month(d) if bucket is None else bucket)
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(FIRST, -1)  # a row a bucket
    # Of changes on one day the last by value counts, as in the order of the window below.
    carried = both.groupBy(key, "_b").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(d, "_v"))).alias("_last"))
    carried = carried.select(key, "_b", F.last("_last", ignorenulls=True).over(before).alias("_old"))
    w = Window.partitionBy(key, "_b").orderBy(d, "_kind", "_v").rowsBetween(FIRST, -1)
    out = _joined(both, carried, key, "_b").withColumn(value, F.coalesce(F.last("_v", ignorenulls=True).over(w), F.col("_old"), F.lit(default)))
    return out.where("_kind = 0").drop("_kind", "_v", "_b", "_old")
