"""Probabilities of finishing orders, synthetic odds, stakes and their limits: column expressions."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The house's share of pair and ordered pools, and of unordered triple pools.
RAKE_PAIR, RAKE_TRIO = 0.175, 0.23


def _left(x: Column, guard: str) -> Column:
    """A denominator: null where it is not positive, or kept off zero."""
    if guard == "skip":
        return F.when(x > 0, x)
    return F.greatest(x, F.lit({"clamp": 1e-4, "cap": 1e-3}[guard]))


def harville_ordered(p1: Column, p2: Column, p3: Column, guard: str = "skip") -> Column:
    """First, second and third in this order: p1 * p2 / (1 - p1) * p3 / (1 - p1 - p2)."""
    return F.coalesce(p1 * p2 / _left(1 - p1, guard) * p3 / _left(1 - p1 - p2, guard), F.lit(0.0))


def harville_trio(p1: Column, p2: Column, p3: Column, guard: str = "skip") -> Column:
    """The three in any order. Guards: skip terms without a positive denominator; clamp them at 1e-4, floor 1e-6; or
    cap the first at 0.95, clamp at 1e-3, floor 1e-5."""
    ps = [F.least(p, F.lit(0.95)) for p in (p1, p2, p3)] if guard == "cap" else [p1, p2, p3]
    # One formula over the six orders: spelt out, it makes methods that the JVM will not compile.
    orders = F.array(*[F.struct(*[p.alias(f"p{k}") for k, p in enumerate(o, 1)]) for o in permutations(ps)])
    total = F.aggregate(orders, F.lit(0.0), lambda s, o: s + harville_ordered(o["p1"], o["p2"], o["p3"], guard=guard))
    return total if guard == "skip" else F.greatest(total, F.lit({"clamp": 1e-6, "cap": 1e-5}[guard]))


def harville_pair(a: Column, b: Column) -> Column:
    """The two in either order."""
    return F.coalesce(a * b / _left(1 - a, "skip"), F.lit(0.0)) + F.coalesce(b * a / _left(1 - b, "skip"), F.lit(0.0))


def synthetic_odds(p: Column, rake: float) -> Column:
    return F.when(p > 0, (1 - rake) / p)


def ev_gate(df: DataFrame, min_ev: float = 1.05, min_p: float = 0.0, ev: str = "ev", p: str = "p") -> DataFrame:
    return df.where((F.col(ev) >= min_ev) & (F.col(p) >= min_p))


def kelly(p: Column, odds: Column, mult: float = 0.25) -> Column:
    """Share of the bankroll: (b p - q) / b times mult, not below 0; 0 at odds of 1 or less."""
    b = odds - 1
    return F.when(b > 0, F.greatest(F.lit(0.0), (b * p - (1 - p)) / b * mult)).otherwise(0.0)


def round_ticket(stake: Column, unit: float = 10.0, minimum: float = 10.0) -> Column:
    """To whole units, halves to even, at least the minimum."""
    return F.greatest(F.lit(minimum), F.rint(stake / unit) * unit)


def caps(df: DataFrame, per_bet: float = 0.05, per_contest: float = 0.05, pool_share: float = 0.02, fraction: str = "fraction", pool: str = "pool", bankroll: float = 10_000.0) -> DataFrame:
    """Fractions within the limits of a bet, of the pool, and of the contest, which bets use up in the order of rank."""
    own = F.least(F.col(fraction), F.lit(per_bet), F.col(pool) * pool_share / bankroll)
    before = F.coalesce(F.sum("_own").over(Window.partitionBy("contest").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return df.withColumn("_own", own).withColumn("capped", F.greatest(F.lit(0.0), F.least("_own", per_contest - before))).drop("_own")


def value_stake(payout: Column, floor: float = 45.0, base: float = 0.01, most: float = 0.035) -> Column:
    """In proportion to the payout from a floor on, up to a limit; 0 below."""
    return F.when(payout >= floor, F.least(base * payout / floor, F.lit(most))).otherwise(0.0)


def regime_prob(df: DataFrame, dim: DataFrame, key: str = "regime") -> DataFrame:
    """Hit probabilities by regime."""
    return df.join(dim, key, "left")
