"""As-of-time features: what was known of a participant or handler before each contest, and of a field within it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIRST = Window.unboundedPreceding


def past(key: str, n: int | None = None):
    """Rows of the key before this one in the order of date and contest: all, or the last n."""
    w = Window.partitionBy(key).orderBy("d", "contest", "participant")
    return w.rowsBetween(FIRST if n is None else -n, -1)


def _wins() -> Column:
    """1 for a win, else 0, also where there is no position."""
    return F.coalesce((F.col("position") == 1).cast("double"), F.lit(0.0))


def lag_deltas(e: DataFrame, cols: tuple[str, ...] = ("weight", "distance"), key: str = "participant") -> DataFrame:
    """Change of each column since the key's previous entry; 0 where either side is missing."""
    w = Window.partitionBy(key).orderBy("d", "contest", "participant")
    return e.withColumns({f"{c}_delta": F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0).cast(e.schema[c].dataType)) for c in cols})


def days_since(e: DataFrame, default: int = 30, key: str = "participant") -> DataFrame:
    w = Window.partitionBy(key).orderBy("d", "contest", "participant")
    return e.withColumn("days_since_last", F.coalesce(F.datediff("d", F.lag("d").over(w)), F.lit(default)))


def prior_wins(e: DataFrame, key: str = "participant") -> DataFrame:
    return e.withColumn("prior_wins", F.coalesce(F.sum((F.col("position") == 1).cast("long")).over(past(key)), F.lit(0).cast("long")))


def prior_rate(e: DataFrame, key: str = "handler", default: float = 0.08) -> DataFrame:
    """Wins by entries before this row."""
    return e.withColumn(f"{key}_prior_rate", F.coalesce(F.avg(_wins()).over(past(key)), F.lit(default)))


def rolling_mean(e: DataFrame, key: str, c: str, n: int, name: str | None = None) -> DataFrame:
    """Mean of the last n entries before this one; rows count whether or not they have a value."""
    return e.withColumn(name or f"rolling_{c}", F.avg(c).over(past(key, n)))


def handler_rate(e: DataFrame, key: str = "handler", n: int = 30, default: float = 0.083, strict: bool = True) -> DataFrame:
    """Win rate over the handler's last n entries. Strict: none of them from the contest itself, so all of a handler's
    entries in a contest get what its first one had."""
    rate = F.coalesce(F.avg(_wins()).over(past(key, n)), F.lit(default))
    e = e.withColumn("handler_rate", rate)
    if strict:
        first = Window.partitionBy(key, "d", "contest").orderBy("participant").rowsBetween(FIRST, 0)
        e = e.withColumn("handler_rate", F.first_value("handler_rate").over(first))
    return e


def counter(e: DataFrame, key: str, name: str = "n_before") -> DataFrame:
    return e.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy("d", "contest", "participant")) - 1)


def carry_down(df: DataFrame, group: str, order: str, header: Column, value: Column, name: str) -> DataFrame:
    """Each row gets the value of the last header row at or before it; a header with a null value resets to null."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(FIRST, 0)
    df = df.withColumn("_block", F.sum(header.cast("int")).over(w)).withColumn("_v", F.when(header, value))
    block = Window.partitionBy(group, "_block").orderBy(order).rowsBetween(FIRST, 0)
    return df.withColumn(name, F.when(F.col("_block") > 0, F.first_value("_v").over(block))).drop("_block", "_v")


# ---- within a contest

def contest_window():
    return Window.partitionBy("contest")


def pressure(e: DataFrame, c: str, k: int = 3) -> DataFrame:
    """Sum of the k largest values of a contest, and what an entry has beyond it."""
    order = contest_window().orderBy(F.desc_nulls_last(c), "participant")
    e = e.withColumn("_rn", F.row_number().over(order))
    e = e.withColumn("pressure", F.coalesce(F.sum(F.when(F.col("_rn") <= k, F.col(c))).over(contest_window()), F.lit(0.0)))
    return e.withColumn("advantage", F.coalesce(F.col(c), F.lit(0.0)) - F.col("pressure")).drop("_rn")


def rank_in_contest(e: DataFrame, c: str, method: str = "first", desc: bool = True, name: str = "model_rank") -> DataFrame:
    """Ranks with ties as dense, min, or first (by participant)."""
    by = F.desc(c) if desc else F.asc(c)
    f = {"dense": F.dense_rank, "min": F.rank, "first": F.row_number}[method]
    return e.withColumn(name, f().over(contest_window().orderBy(by, *(["participant"] if method == "first" else []))))


def public_rank(e: DataFrame) -> DataFrame:
    return rank_in_contest(e, "odds", "min", False, "public_rank")


def softmax(e: DataFrame, c: str, name: str = "softmax") -> DataFrame:
    x = F.exp(F.col(c) - F.max(c).over(contest_window()))
    return e.withColumn("_x", x).withColumn(name, F.col("_x") / F.sum("_x").over(contest_window())).drop("_x")


def share(e: DataFrame, c: Column, name: str = "share") -> DataFrame:
    """c over its sum in the contest."""
    return e.withColumn("_x", c).withColumn(name, F.try_divide("_x", F.sum("_x").over(contest_window()))).drop("_x")


def min_field(e: DataFrame, n: int) -> DataFrame:
    return e.withColumn("field", F.count("*").over(contest_window())).where(F.col("field") >= n)


# ---- money over time


def _by_days(bets: DataFrame, c: str, by: list[str], f) -> tuple[DataFrame, Column, Column]:
    """bets with what f makes of the days before within by; that, and what f makes of the day's bets so far. A task sees
    one day's bets, or one row a day."""
    before = Window.partitionBy(*by).orderBy("d").rowsBetween(FIRST, -1)
    days = bets.groupBy(*by, "d").agg(f(c).alias("_day")).select(*by, "d", f("_day").over(before).alias("_before"))
    so_far = Window.partitionBy(*by, "d").orderBy("contest").rowsBetween(FIRST, 0)
    return bets.join(days, [*by, "d"]), F.col("_before"), f(c).over(so_far)


def running_sum(bets: DataFrame, c: str, by: list[str], name: str) -> DataFrame:
    """Sum of c over the bets of by up to and with each, in the order of date and contest."""
    out, before, so_far = _by_days(bets, c, by, F.sum)
    return out.withColumn(name, F.coalesce(before, F.lit(0.0)) + so_far).drop("_before")


def equity(bets: DataFrame, pnl: str = "pnl", by: str = "season", start: float = 0.0, mode: str = "flat") -> DataFrame:
    """Bankroll after each bet. mode flat: pnl is money, and adds up. mode kelly: pnl is the result as a share of the
    bankroll before the bet; bankrolls are products, made as sums of logarithms in parallel, and growth is the logarithm
    of the bankroll over start, which stays finite where the bankroll doesn't. A bet that loses all ends at 0, for good."""
    if mode == "flat":
        return running_sum(bets, pnl, [by], "bankroll").withColumn("bankroll", F.col("bankroll") + F.lit(start))
    out = running_sum(bets.withColumn("_ln", log_factor(F.col(pnl))), "_ln", [by], "growth").drop("_ln")
    return out.withColumn("bankroll", F.exp("growth") * start)


def log_factor(r: Column) -> Column:
    """Logarithm of what a bankroll is multiplied with by a result of r times itself; minus infinity from -1 down."""
    return F.when(r > -1, F.log1p(r)).otherwise(F.lit(float("-inf")))


def drawdown(bets: DataFrame, by: str = "season", bankroll: str = "bankroll") -> DataFrame:
    """Running peak, and how far below it the bankroll is, as a share of it."""
    out, before, so_far = _by_days(bets, bankroll, [by], F.max)
    return out.withColumn("peak", F.greatest(before, so_far)).withColumn("drawdown", F.try_divide(F.col("peak") - F.col(bankroll), F.col("peak"))).drop("_before")
