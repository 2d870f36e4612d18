"""Bankrolls carried from contest to contest.

Tickets don't depend on the bankroll and are made in parallel. Flat stakes add up, and stakes that are shares of the
bankroll multiply; both are running sums (of logarithms for shares) over days, in parallel. Only rounded stakes need a
fold: of each group (a season and a configuration) tickets are read in their order, and a task holds one contest's
tickets and the bankroll, however long the group is.

Bankrolls may leave the range of doubles, upwards or, with shares, downwards. Amounts are therefore in units of 2 ** scale;
scale is 0 until a bankroll reaches 2 ** BITS, or falls to 2 ** -BITS of its start, and a multiple of BITS from there on.
Rounding to whole units changes nothing in numbers that large.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyard.operators import history as H
from tallyard.sources.shipping import ship


@dataclass(frozen=True)
class Stake:
    """What is staked on a ticket of n equal combinations.

    how: flat (amount on each combination), share (the ticket's fraction of the bankroll), rounded (that fraction over
    the combinations, each to whole units, halves to even).
    minimum: a rounded stake on a combination is raised to it. cap: what a contest's ticket may cost; rounded again.
    least: rounded tickets that cost less are left out; least_risk: so are those whose fraction is worth less.
    within: tickets above the bankroll are left out. ruin: at this bankroll or below betting ends.
    """

    how: str = "flat"
    amount: float = 10.0
    start: float = 100_000.0
    unit: float = 10.0
    minimum: float = 0.0
    cap: float = 0.0
    least: float = 0.0
    least_risk: float = 0.0
    within: bool = False
    ruin: float = float("-inf")

    def each(self, bank: float, fraction: float, n: int, scale: int = 0) -> float:
        """The stake on each combination. bank, and the result, are in units of 2 ** scale."""
        one = 0.5**scale
        if self.how == "flat":
            return self.amount * one
        risk = bank * fraction
        if self.how == "share":
            return risk / n
        if risk < self.least_risk * one:
            return 0.0
        each = max(self.minimum * one, risk / n if scale else round(risk / n / self.unit) * self.unit)
        if self.cap and each * n > self.cap * one:
            each = round(self.cap / n / self.unit) * self.unit * one
        return 0.0 if each * n < self.least * one or (self.within and each * n > bank) else each


BITS = 200
#: Logarithm that stands for losing all; half of it and less is a bankroll of nothing.
LOST = -1e6
STEP = "season string, config string, d date, contest long, tickets int, staked double, returned double, won int, bank double, scale int"
_STEP = pa.schema([("season", pa.string()), ("config", pa.string()), ("d", pa.date32()), ("contest", pa.int64()), ("tickets", pa.int32()), ("staked", pa.float64()), ("returned", pa.float64()), ("won", pa.int32()), ("bank", pa.float64()), ("scale", pa.int32())])
_BY = ["season", "config"]


def fold(tickets: DataFrame, stake: Stake) -> DataFrame:
    """season, config, d, contest, tickets, staked, returned, won, bank (after it), scale of every contest that is bet on.

    tickets: season, config, d, contest, k (their order in the contest), n (combinations), fraction, odds (what one unit
    of a combination's stake is paid; null for nothing), won. Every group starts anew; all tickets of a contest see the
    bankroll before it. An empty table gives no rows.
    """
    if stake.how == "rounded" or stake.ruin > float("-inf"):
        return _rounded(tickets, stake)
    own = F.col("n") * F.lit(stake.amount) if stake.how == "flat" else F.col("fraction")
    paid = F.when(F.col("won") == 1, F.coalesce(own / F.col("n") * F.col("odds"), F.lit(0.0))).otherwise(0.0)
    bets = tickets.withColumns({"staked": own.cast("double"), "returned": paid.cast("double")}).where("staked > 0")
    contests = bets.groupBy(*_BY, "d", F.col("contest").cast("long").alias("contest")).agg(F.count("*").cast("int").alias("tickets"), F.sum("staked").alias("staked"), F.sum("returned").alias("returned"), F.max("won").cast("int").alias("won"))
    net = F.col("returned") - F.col("staked")
    if stake.how == "flat":
        out = H.running_sum(contests.withColumn("_x", net), "_x", _BY, "bank")
        return out.withColumns({"bank": F.col("bank") + stake.start, "scale": F.lit(0)}).select(*_STEP.names)
    out = H.running_sum(contests.withColumn("_x", F.greatest(H.log_factor(net), F.lit(LOST))), "_x", _BY, "_growth")
    before = F.col("_growth") - F.col("_x")
    scale = (before / (math.log(2) * BITS)).cast("int") * BITS  # towards 0
    out = out.withColumns({"scale": scale, "_bank": F.when(before > LOST / 2, F.exp(before - F.col("scale") * math.log(2)) * stake.start).otherwise(0.0)})
    out = out.withColumn("bank", F.col("_bank") * (1 + F.greatest(net, F.lit(-1.0)))).withColumns({c: F.col(c) * F.col("_bank") for c in ("staked", "returned")})
    return out.where("staked > 0").select(*_STEP.names)  # nothing is staked of a lost bankroll


def _rounded(tickets: DataFrame, stake: Stake) -> DataFrame:
    ship(tickets.sparkSession)
    high, step = 2.0**BITS, 0.5**BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = contest = None
        bank, scale, staked, returned, n, won = stake.start, 0, 0.0, 0.0, 0, 0
        rows: list[tuple] = []

        def close():
            nonlocal bank, scale, staked, returned, n, won
            if n:
                bank = bank - staked + returned
                rows.append((*group, *contest, n, staked, returned, won, bank, scale))
                if bank > high:
                    bank, scale = bank * step, scale + BITS
            staked, returned, n, won = 0.0, 0.0, 0, 0

        for b in batches:
            for season, config, d, c, combinations, fraction, odds, hit in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if (season, config) != group:
                    close()
                    group, contest, bank, scale = (season, config), (d, c), stake.start, 0
                elif (d, c) != contest:
                    close()
                    contest = (d, c)
                each = stake.each(bank, fraction or 0.0, combinations, scale) if scale or bank > stake.ruin else 0.0
                if each > 0:
                    staked += each * combinations
                    returned += each * odds if hit and odds is not None else 0.0
                    n, won = n + 1, max(won, hit)
            if rows:
                yield _batch(rows)
                rows.clear()
        close()
        if rows:
            yield _batch(rows)

    order = [*_BY, "d", "contest", "k"]
    rows = tickets.repartition(*_BY).sortWithinPartitions(*order)
    return rows.select(*_BY, "d", F.col("contest").cast("long"), F.col("n").cast("int"), F.col("fraction").cast("double"), F.col("odds").cast("double"), F.col("won").cast("int")).mapInArrow(run, STEP)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _STEP, strict=True)], schema=_STEP)


def plain(steps: DataFrame) -> DataFrame:
    """Steps with amounts as they are, infinite where they are beyond doubles, and without scale."""
    return steps.withColumns({c: F.col(c) * F.pow(F.lit(2.0), "scale") for c in ("staked", "returned", "bank")}).drop("scale")


def ledger(steps: DataFrame, start: float) -> DataFrame:
    """Per season and config: contests, hits, staked and returned in units of 2 ** top (the largest scale), bank (the last
    bankroll, infinite beyond doubles), growth (its logarithm over start, null from 0 down), low (the least bankroll over
    start). Steps are read once, as a fold may have made them."""
    sums = [F.sum(c).alias(c) for c in ("staked", "returned")]
    by_scale = steps.groupBy(*_BY, "scale").agg(
        *sums, F.count("*").alias("contests"), F.sum("won").alias("hits"), F.max(F.struct("d", "contest", "bank", "scale")).alias("_last"), F.min(F.col("bank") * F.pow(F.lit(2.0), "scale")).alias("low")
    )
    each = F.collect_list(F.struct("scale", "staked", "returned")).alias("x")  # a row a scale
    out = by_scale.groupBy(*_BY).agg(F.max("scale").alias("top"), each, F.sum("contests").alias("contests"), F.sum("hits").alias("hits"), F.max("_last").alias("_last"), F.min("low").alias("low"))
    total = {c: F.aggregate("x", F.lit(0.0), lambda s, r: s + r[c] * F.pow(F.lit(2.0), r["scale"] - F.col("top"))) for c in ("staked", "returned")}  # noqa: B023
    growth = F.when(F.col("_last.bank") > 0, F.log(F.col("_last.bank") / start) + F.col("_last.scale") * math.log(2))
    bank = F.col("_last.bank") * F.pow(F.lit(2.0), F.col("_last.scale"))
    return out.select(*_BY, "top", *[t.alias(c) for c, t in total.items()], "contests", "hits", (F.least("low", F.lit(start)) / start).alias("low"), growth.alias("growth"), bank.alias("bank"))


def season_ledger(steps: DataFrame, start: float, priced: bool = True, flat: bool = False) -> DataFrame:
    """Per season and config: contests, hits, roi, growth (logarithm of the bankroll over its start), low (least bankroll
    over its start), break_even (what a hit has to pay, of flat stakes). Without prices roi, growth and low are null."""
    if_priced = lambda c: c if priced else F.lit(None).cast("double")
    return ledger(steps, start).select(
        *_BY, "contests", "hits", if_priced(F.round(F.try_divide("returned", "staked") - 1, 6)).alias("roi"), if_priced(F.round("growth", 6)).alias("growth"), if_priced(F.round("low", 6)).alias("low"),
        (F.round(F.try_divide("staked", "hits"), 4) if flat else F.lit(None).cast("double")).alias("break_even"),
    )
