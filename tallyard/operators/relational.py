"""Joins, aggregations, top-k and set operations on contests and entries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyard.functions.scalars import season_label
from tallyard.sources.storage import last_of

# ---- joins


def attach(df: DataFrame, other: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    return df.join(other, keys, how)


def join_odds(features: DataFrame, odds: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join, one row a key: of rows that share it the last by all columns."""
    return last_of(features.join(odds, keys), keys)


def join_payouts(df: DataFrame, payouts: DataFrame, keys: list[str], payout: str = "payout") -> DataFrame:
    """Left join; rows without a payout are dropped."""
    return df.join(payouts, keys, "left").where(F.col(payout).isNotNull())


def lookup(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Left join to a dimension, one row a key (the last by all columns); Spark broadcasts it where its size allows."""
    return df.join(last_of(dim, [key]), key, "left")


def orphans(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    return df.join(dim, key, "left_anti")


def pending(candidates: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Candidates that are not among those done."""
    return candidates.join(done.select(key), key, "left_anti")


def pairs(e: DataFrame, cols: list[str], ordered: bool = True, contest: str = "contest", who: str = "participant") -> DataFrame:
    """Pairs of entries of one contest: cols with suffixes _a and _b. Contests are small, and both sides share one exchange."""
    a = e.select(contest, *[F.col(c).alias(f"{c}_a") for c in cols])
    b = e.select(contest, *[F.col(c).alias(f"{c}_b") for c in cols])
    x, y = F.col(f"{who}_a"), F.col(f"{who}_b")
    return a.join(b, contest).where(x != y if ordered else x < y)


def combos(e: DataFrame, k: int, cols: list[str], order: str, contest: str = "contest", anchor: str | None = None, ordered: bool = False) -> DataFrame:
    """Combinations of k entries of one contest, cols with suffixes _1 to _k.

    Unordered ones ascend by order; with anchor, a column of 0 and 1, the first is an anchor and the others are not. They
    are made within an array of the contest's entries, so one exchange by contest serves this and what is done by contest
    before and after. The entries are expected to have been cut to a few for each contest.
    """
    one = F.struct(F.col(order).alias("_o"), F.struct(*cols).alias("_x"), *([F.col(anchor).alias("_a")] if anchor else []))
    rows = e.groupBy(contest).agg(F.sort_array(F.collect_list(one)).alias("_f"))
    for j in range(1, k + 1):  # an entry more each time: its place among those it may be taken from, and those left after it
        pool = F.filter("_f", lambda x: x["_a"] == 1) if anchor and j == 1 else F.col("_f")
        rows = rows.select(contest, *[f"_{i}" for i in range(1, j)], "_f", F.posexplode(pool).alias("_at", f"_{j}"))
        if j == k:
            break
        if anchor and j == 1:
            left = F.filter("_f", lambda x: x["_a"] == 0)
        elif ordered:
            left = F.filter("_f", lambda x, i: i != F.col("_at"))
        else:
            left = F.slice("_f", F.col("_at") + 2, F.size("_f"))
        rows = rows.select(contest, *[f"_{i}" for i in range(1, j + 1)], left.alias("_f"))
    return rows.select(contest, *[F.col(f"_{j}._x")[c].alias(f"{c}_{j}") for j in range(1, k + 1) for c in cols])


def assign_folds(e: DataFrame, folds: DataFrame, d: str = "d") -> DataFrame:
    """fold and part (train or test) of every entry whose date lies in a fold's window."""
    day = F.col(d)
    part = F.when(day.between(F.col("train_start"), F.col("train_end")), "train").when(day.between(F.col("test_start"), F.col("test_end")), "test")
    return e.join(folds, day.between(F.least("train_start", "test_start"), F.greatest("train_end", "test_end"))).withColumn("part", part).where("part IS NOT NULL")


def settle_bets(bets: DataFrame, payouts: DataFrame, contest: str = "contest", combo: str = "combo") -> DataFrame:
    """Bets with won and returned: a combination wins what equal ones are paid for each 10 of stake, dead heats added up."""
    paid = payouts.groupBy(contest, combo).agg(F.sum("dividend").alias("_paid"))
    out = bets.join(paid, [contest, combo], "left")
    return out.withColumns({"won": F.col("_paid").isNotNull().cast("int"), "returned": F.coalesce(F.col("stake") / 10 * F.col("_paid"), F.lit(0.0))}).drop("_paid")


def as_of(e: DataFrame, history: DataFrame, key: str, value: str, default, d: str = "d", valid: str = "valid_from") -> DataFrame:
    """The value known strictly before each entry's date: one ordered pass over entries and changes of each key."""
    marks = e.select(*e.columns, F.lit(0).alias("_kind"), F.lit(None).cast(history.schema[value].dataType).alias("_v"))
    changes = history.select(F.col(key), F.col(valid).alias(d), F.lit(1).alias("_kind"), F.col(value).alias("_v"))
    w = Window.partitionBy(key).orderBy(d, "_kind").rowsBetween(Window.unboundedPreceding, -1)
    both = marks.unionByName(changes, allowMissingColumns=True)
    return both.withColumn(value, F.coalesce(F.last("_v", ignorenulls=True).over(w), F.lit(default))).where("_kind = 0").drop("_kind", "_v")


# ---- aggregations


def dedupe(df: DataFrame, keys: list[str], order: list[Column], keep: str = "last") -> DataFrame:
    """The last or first row of each key by an explicit order."""
    by = order if keep == "first" else [c.desc() for c in order]
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_rn = 1").drop("_rn")


def counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def distinct_count(df: DataFrame, cols: list[str], name: str = "n") -> DataFrame:
    return df.agg(F.count_distinct(*cols).alias(name))


def bettable_flag(meta: DataFrame, payouts: DataFrame, contest: str = "contest", d: str = "d") -> DataFrame:
    """is_bettable: the contest has payouts, and so has its meeting."""
    own = payouts.groupBy(contest).agg(F.count("*").alias("n_payouts"))
    out = meta.join(own, contest, "left").fillna(0, ["n_payouts"])
    meeting = F.sum("n_payouts").over(Window.partitionBy(d))
    return out.withColumn("is_bettable", ((F.col("n_payouts") > 0) & (meeting > 0)).cast("int"))


def null_audit(df: DataFrame, cols: list[str]) -> DataFrame:
    missing = lambda c: F.col(c).isNull() | F.col(c).cast("string").isin("NaN", "nan")
    return df.agg(F.count("*").alias("rows"), *[F.count_if(missing(c)).alias(f"missing_{c}") for c in cols])


def summary(df: DataFrame, c: str, d: str) -> DataFrame:
    return df.agg(F.round(F.avg(c), 2).alias("mean"), F.round(F.max(c), 2).alias("high"), F.round(F.min(c), 2).alias("low"), F.min(d).alias("first"), F.max(d).alias("last"))


def top_peak(df: DataFrame, key: str, value: str, label: str, k: int) -> DataFrame:
    """The k keys with the highest peaks, and the label each had then."""
    peak = df.groupBy(key).agg(F.max(value).alias("peak"), F.max_by(label, F.struct(value, label)).alias(label))
    return peak.orderBy(F.desc("peak"), key).limit(k)


def season_counts(df: DataFrame, d: str = "d", contest: str = "contest") -> DataFrame:
    """Entries and contests of each season."""
    return df.groupBy(season_label(F.col(d)).alias("season")).agg(F.count("*").alias("n"), F.count_distinct(contest).alias("contests"))


def brier(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


def log_loss(p: Column, y: Column, eps: float = 1e-15) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return -F.avg(y * F.log(q) + (1 - y) * F.log(1 - q))


def completeness_audit(days: DataFrame, e: DataFrame, d: str = "d", number: str = "contest_no") -> DataFrame:
    """Candidate days with how many contests came in, up to which number, and what is wrong: missing or gaps."""
    have = e.groupBy(d).agg(F.count_distinct(number).alias("n"), F.max(number).alias("highest"))
    out = days.join(have, d, "left").fillna(0, ["n", "highest"])
    return out.withColumn("state", F.when(F.col("n") == 0, "missing").when(F.col("n") < F.col("highest"), "gaps").otherwise("complete"))


# ---- top-k and sets


def top_n(e: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark cuts groups before the shuffle already."""
    return e.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rn") <= n)


def bottom_n(e: DataFrame, by: list[str], c: str, n: int, tie: str = "participant") -> DataFrame:
    """The n smallest of each group."""
    return top_n(e, by, [F.asc(c), F.asc(tie)], n)


def arg_max(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The row of each group with the greatest order."""
    best = df.groupBy(*by).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("x"))
    return best.select("x.*")


def union_ragged(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def covers(a: Column, b: Column) -> Column:
    """Every element of b is in a."""
    return F.size(F.array_except(b, a)) == 0
