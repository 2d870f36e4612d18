"""Bets: settlement, ledgers, sweeps, strategies, diagnostics of model against market."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyard.functions import pricing as P
from tallyard.functions.scalars import distance_regime
from tallyard.operators import history as H
from tallyard.operators.ledger import Stake, fold, ledger
from tallyard.operators.relational import brier, settle_bets

# ---- ledgers


def flat_ledger(bets: DataFrame, *by: str) -> DataFrame:
    """Bets, hits, hit rate, staked, returned, net and return on stakes, overall or by columns."""
    staked, returned = F.sum("staked"), F.sum("returned")
    return bets.groupBy(*by).agg(
        F.count("*").alias("bets"), F.sum(F.col("won").cast("long")).alias("hits"), F.round(F.avg(F.col("won").cast("double")), 6).alias("hit_rate"), F.round(staked, 2).alias("staked"),
        F.round(returned, 2).alias("returned"), F.round(returned - staked, 2).alias("net"), F.round(F.try_divide(returned - staked, staked), 6).alias("roi"),
    )


def break_even(bets: DataFrame) -> DataFrame:
    """The payout a hit needs for staked and returned to be equal."""
    return bets.agg(F.round(F.try_divide(F.sum("staked"), F.sum("won")), 6).alias("break_even"))


def tier_ledger(e: DataFrame, tiers: int = 6) -> DataFrame:
    """Top model picks by public rank, and an overall row (tier null)."""
    picks = e.where((F.col("model_rank") == 1) & (F.col("public_rank") <= tiers)).select(F.col("public_rank").alias("tier"), (F.col("position") == 1).alias("won"), "odds")
    paid = F.sum(F.when(F.col("won"), F.col("odds")).otherwise(0.0))
    return picks.rollup("tier").agg(F.count("*").alias("bets"), F.count_if("won").alias("wins"), F.round(100 * F.avg(F.col("won").cast("double")), 4).alias("win_pct"), F.round(100 * (paid / F.count("*") - 1), 4).alias("roi_pct"))


def _sweep(e: DataFrame, grid: DataFrame, other: str, value: Column, hit: Column) -> DataFrame:
    """ROI per cell at stakes of 10: each row joins the cells whose floors it reaches."""
    cells = e.join(grid, (F.col("odds") >= F.col("floor")) & (value >= F.col(other)))
    paid = F.sum(F.when(hit, F.col("odds") * 10).otherwise(0.0))
    return cells.groupBy("floor", other).agg(F.count("*").alias("bets"), F.count_if(hit).alias("hits"), F.round(paid - F.count("*") * 10, 2).alias("profit"), F.round(paid / (F.count("*") * 10) - 1, 6).alias("roi"))


def grid_of(spark, floors: list[float], others: list[float], name: str) -> DataFrame:
    return spark.createDataFrame([(f, o) for f in floors for o in others], f"floor double, {name} double")


def sweep_odds_delta(e: DataFrame, grid: DataFrame) -> DataFrame:
    """Top pick of each contest with odds from a floor on and p beyond the implied one by a delta."""
    return _sweep(e.where("model_rank = 1"), grid, "delta", F.col("p") - 1 / F.col("odds"), F.col("position") == 1)


def sweep_odds_place(e: DataFrame, grid: DataFrame) -> DataFrame:
    """Model ranks up to 3 with odds from a floor on and a probability to place from a threshold on."""
    return _sweep(e.where("model_rank <= 3"), grid, "threshold", F.col("p"), F.col("position") <= 3)


def regime_report(e: DataFrame) -> DataFrame:
    """Per distance regime: entries and Brier score, and executions and hit rate of top picks at odds up to 5."""
    e = e.withColumn("regime", distance_regime(F.col("distance")))
    rows = e.groupBy("regime").agg(F.count("*").alias("rows"), F.round(brier(F.col("p"), (F.col("position") == 1).cast("double")), 6).alias("brier"))
    runs = e.where("model_rank = 1 AND odds <= 5").groupBy("regime").agg(F.count("*").alias("executions"), F.round(F.avg((F.col("position") == 1).cast("double")), 6).alias("hit_rate"))
    return rows.join(runs, "regime", "left")


def season_summary(bets: DataFrame, start: float = 10_000.0) -> DataFrame:
    """Per season: bets, wins, strike, staked, returned, net, roi, Sharpe (population), maximum drawdown, mean winning odds."""
    b = bets.withColumn("pnl", F.col("returned") - F.col("staked")).withColumn("r", F.try_divide("pnl", "staked"))
    b = H.drawdown(H.equity(b, start=start))
    return b.groupBy("season").agg(
        F.count("*").alias("n"), F.sum(F.col("won").cast("long")).alias("wins"), F.round(F.avg(F.col("won").cast("double")), 6).alias("strike"), F.round(F.sum("staked"), 2).alias("staked"),
        F.round(F.sum("returned"), 2).alias("returned"), F.round(F.sum("pnl"), 2).alias("net"), F.round(F.try_divide(F.sum("pnl"), F.sum("staked")), 6).alias("roi"),
        F.round(F.try_divide(F.avg("r"), F.stddev_pop("r")), 6).alias("sharpe"), F.round(F.max("drawdown"), 6).alias("max_drawdown"),
        F.round(F.avg(F.when(F.col("won") == 1, F.try_divide("returned", "staked"))), 6).alias("winning_odds"),
    )


def pooled(bets: DataFrame) -> DataFrame:
    """Unweighted mean of per-bet returns."""
    return bets.agg(F.count("*").alias("bets"), F.round(F.avg(F.try_divide(F.col("returned") - F.col("staked"), "staked")), 6).alias("mean_return"))


#: Groups that rows are dealt to before they are resampled.
BUCKETS = 1024


def bootstrap_ci(df: DataFrame, c: str, key: Column, reps: int = 1000, seed: int = 42, by: str | None = None) -> DataFrame:
    """Mean and 2.5 and 97.5 percentiles of resampled means, over all rows, or for each value of by and all (by null).

    Rows are dealt to BUCKETS groups by a hash of their key, and it is groups that are resampled: sums of groups are all
    that replicates read, however many rows there are. A group's weight in a replicate is Poisson(1), by a uniform number
    from a hash of the group, the replicate and the seed; a hash serves for four. Rows without a value take no part.
    """
    group = F.col(by) if by else F.lit(None).cast("string")
    number = lambda mark, at: F.conv(F.substring(mark, at, 8), 16, 10).cast("long")
    rows = df.where(F.col(c).isNotNull()).select(F.col(c).cast("double").alias("x"), (number(F.md5(key.cast("string")), 1) % BUCKETS).alias("bucket"), group.alias("by"))
    rows = rows.groupBy("by", "bucket").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    cuts, p, total = [], math.exp(-1), 0.0
    for k in range(8):
        total += p
        cuts.append(total)
        p /= k + 1
    marks = df.sparkSession.range(BUCKETS).select(F.col("id").alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(-(-reps // 4) - 1))).alias("g"))
    marks = marks.withColumn("mark", F.md5(F.concat_ws(":", F.col("bucket").cast("string"), F.col("g").cast("string"), F.lit(str(seed)))))
    u = [(number("mark", 8 * j + 1).cast("double") + 0.5) / 4294967296.0 for j in range(4)]
    marks = marks.select("bucket", "g", *[x.alias(f"u{j}") for j, x in enumerate(u)])
    marks = marks.select("bucket", "g", *[sum(((F.col(f"u{j}") > cut).cast("int") for cut in cuts), F.lit(0)).alias(f"w{j}") for j in range(4)])
    sums = rows.join(marks, "bucket").groupBy("by", "g").agg(*[F.sum(F.col("x") * F.col(f"w{j}")).alias(f"s{j}") for j in range(4)], *[F.sum(F.col("n") * F.col(f"w{j}")).alias(f"n{j}") for j in range(4)])
    each = sums.select("by", "g", F.posexplode(F.array(*[F.struct(F.col(f"s{j}").alias("s"), F.col(f"n{j}").alias("n")) for j in range(4)])).alias("j", "r")).where(F.col("g") * 4 + F.col("j") < reps)
    every = each.groupBy("g", "j").agg(F.sum("r.s").alias("s"), F.sum("r.n").alias("n")).select(F.lit(None).cast(each.schema["by"].dataType).alias("by"), F.try_divide("s", "n").alias("m"))
    means = every.unionByName(each.select("by", F.try_divide("r.s", "r.n").alias("m"))) if by else every
    out = means.groupBy("by").agg(F.round(F.avg("m"), 4).alias("mean"), F.round(F.percentile("m", F.lit(0.025)), 4).alias("low"), F.round(F.percentile("m", F.lit(0.975)), 4).alias("high"))
    return out.withColumnRenamed("by", by) if by else out.drop("by")


# ---- diagnostics


def ranking_diagnostics(e: DataFrame) -> DataFrame:
    """Per contest: did model's and market's first pick win or place, were the top three hit, where do the two differ."""
    e = H.rank_in_contest(H.rank_in_contest(e, "score", "first", True, "m"), "odds", "first", False, "p")
    three = lambda c: F.array_sort(F.collect_set(F.when(F.col(c) <= 3, F.col("participant"))))
    first = lambda c, v: F.max(F.when(F.col(c) == 1, F.col(v)))
    g = e.groupBy("contest", "season").agg(three("m").alias("m3"), three("p").alias("p3"), three("position").alias("a3"), first("m", "position").alias("mp"), first("p", "position").alias("pp"), first("m", "participant").alias("m1"), first("p", "participant").alias("p1"))
    flag = lambda c: c.cast("int")
    differ = F.col("m1") != F.col("p1")
    return g.select(
        "contest", "season", flag(F.col("mp") == 1).alias("m_top1_win"), flag(F.col("pp") == 1).alias("p_top1_win"), flag(F.col("mp") <= 3).alias("m_top1_place"), flag(F.col("pp") <= 3).alias("p_top1_place"),
        flag(F.col("m3") == F.col("a3")).alias("m_top3_exact"), flag(F.col("p3") == F.col("a3")).alias("p_top3_exact"), F.size(F.array_intersect("m3", "a3")).alias("m_overlap"), F.size(F.array_intersect("p3", "a3")).alias("p_overlap"),
        flag(differ).alias("diverge"), F.when(differ, flag(F.col("mp") < F.col("pp"))).alias("m_beats_p"),
    )


def diagnostic_means(diag: DataFrame) -> DataFrame:
    """Means per season and overall (season null), and the model's edge over the market."""
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    cols = [c for c in diag.columns if c not in ("contest", "season")]
    out = diag.rollup("season").agg(F.count("*").alias("contests"), *[mean(c).alias(c) for c in cols])
    return out.withColumn("edge", F.round(F.col("m_top1_win") - F.col("p_top1_win"), 6))


def diagnostic_report(diag: DataFrame, reps: int = 2000) -> DataFrame:
    """diagnostic_means with a verdict: whose first pick is ahead where they differ, if the interval of resampled means
    leaves one half out, else even."""
    ci = bootstrap_ci(diag.withColumn("m_beats_p", F.col("m_beats_p").cast("double")), "m_beats_p", F.col("contest"), reps, by="season").select(F.col("season").alias("_season"), F.col("low"), F.col("high"))
    out = diagnostic_means(diag)
    out = out.join(ci, F.col("season").eqNullSafe(F.col("_season")), "left").drop("_season")
    return out.withColumn("verdict", F.when(F.col("low") > 0.5, "model").when(F.col("high") < 0.5, "market").otherwise("even"))


# ---- compounding


def compounding_ledger(bets: DataFrame, configs: DataFrame, start: float = 10_000.0, unit: float = 10.0) -> DataFrame:
    """Final bankroll, n (bets made), wins, turnover and low (least bankroll) of each (season, config); growth and
    log_turnover are logarithms of bankroll and turnover over start, finite where these are beyond doubles.

    configs: config, mult (of Kelly's fraction) and floor (of the odds). Stakes are rounded, at least one unit, and left
    out above the bankroll.
    """
    every = bets.join(configs, F.col("odds") >= F.col("floor"))
    fraction = P.kelly(F.col("p"), F.col("odds"), 1.0) * F.col("mult")
    tickets = every.withColumns({"fraction": fraction, "k": F.lit(1), "n": F.lit(1)}).where("fraction > 0")
    steps = fold(tickets, Stake("rounded", start=start, unit=unit, minimum=unit, within=True))
    return ledger(steps, start).select(
        "season", "config", F.round("bank", 2).alias("bankroll"), "growth", F.col("contests").alias("n"), F.col("hits").alias("wins"), F.round(F.col("staked") * F.pow(F.lit(2.0), "top"), 2).alias("turnover"),
        (F.log(F.col("staked") / start) + F.col("top") * math.log(2)).alias("log_turnover"), F.round(F.col("low") * start, 2).alias("low"),
    )


# ---- settlement


def settle_actual(bets: DataFrame, payouts: DataFrame) -> DataFrame:
    return settle_bets(bets, payouts)


def settle_synthetic(bets: DataFrame) -> DataFrame:
    """Per contest: the mean synthetic payout if the anchor and at least two legs are among the first three."""
    legs = F.sum(((F.col("position") <= 3) & (F.col("anchor") == 0)).cast("int"))
    lead = F.max(((F.col("position") <= 3) & (F.col("anchor") == 1)).cast("int"))
    g = bets.groupBy("contest").agg(lead.alias("lead"), legs.alias("legs"), F.avg("pay").alias("pay"))
    won = (F.col("lead") == 1) & (F.col("legs") >= 2)
    return g.select("contest", won.cast("int").alias("won"), F.when(won, F.col("pay")).otherwise(0.0).alias("returned"))
