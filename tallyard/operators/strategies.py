"""Strategies as parameters: which tickets a contest gives, what they pay, and what is staked on them.

Tickets are made for all contests at once, without a bankroll; `ledger.fold` then stakes them in order. Calibrated
probabilities rise with the score, so ranks by score are ranks by any of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyard.functions import pricing as P
from tallyard.functions.scalars import distance_regime
from tallyard.operators import history as H
from tallyard.operators.ledger import Stake, fold, plain, season_ledger
from tallyard.operators.relational import combos, settle_bets

# Hit rates of the ordered wheel by distance regime, of the banker, and of the wheel as a whole.
REGIME_HITS = {"Mile": 0.077748, "Sprint": 0.055276, "Stayer": 0.07}
BANKER_HITS, WHEEL_HITS = 0.1002, 0.0768
#: What a unit on the winning combination of the wheel, and on the banker's ticket, is taken to pay.
WHEEL_ODDS, BANKER_ODDS = 250.0, 25.0


@dataclass(frozen=True)
class Spec:
    """kind: single (first picks by model), box (pairs of its top three), banker (a long shot with the two favourites),
    wheel (the top pick to win over four legs in either order), trio (the top pick over pairs of four legs, in any order),
    sweep (all triples of the top seven).

    pays: win, hits (not priced), harville (of the market's probabilities), raw (of its odds as they are), actual, fixed.
    p: the probability that Kelly and gates take: p (win), meta, place, regime, top (p among the top seven).
    """

    kind: str
    stake: Stake = field(default_factory=Stake)
    pays: str = "win"
    p: str = "p"
    top: int = 1
    min_public_rank: int = 1
    min_field: int = 1
    mult: float = 0.25
    cap: float = 1.0
    rake: float = P.RAKE_TRIO
    min_ev: float = 0.0
    min_p: float = 0.0
    min_payout: float = 0.0
    dark_horse: int = 0
    fixed_fraction: float | None = None
    value_stakes: bool = False
    per_ticket: bool = False
    guard: str = "clamp"


def _kelly(p: float, odds: float, mult: float) -> float:
    return max(0.0, ((odds - 1) * p - (1 - p)) / (odds - 1) * mult)


_SHARE = Stake("share", start=10_000.0)
_WHEEL = Stake("rounded", least=120.0, ruin=120.0)
_TRIO = Stake("rounded", least=60.0, ruin=60.0)
_SWEEP = Stake("rounded", least=10.0, ruin=10.0)
_SINGLE = {"kind": "single", "stake": _SHARE, "min_public_rank": 3, "cap": 0.05}
_BOX = {"kind": "box", "min_field": 8, "rake": P.RAKE_PAIR}

#: Parameters of the known rules. Rules that differ in how their models were trained alone share theirs (v5 and v6, v6_1
#: and v7_1, v14 and v16).
SPECS: dict[str, Spec] = {
    "v3": Spec("single", Stake("flat", 100.0)),
    "v4": Spec(**_SINGLE), "v5": Spec(**_SINGLE, p="meta"), "v6": Spec(**_SINGLE, p="meta"),
    "v6_1": Spec(**_SINGLE, p="meta", top=3), "v7_1": Spec(**_SINGLE, p="meta", top=3),
    "v8_0": Spec(**_BOX, pays="hits"), "v8_1": Spec(**_BOX, pays="harville"),
    "v8_2": Spec(**_BOX, stake=_SHARE, pays="harville", min_payout=45.0, value_stakes=True),
    "v8_3": Spec(**_BOX, pays="harville", dark_horse=5),
    "v8_4": Spec(**_BOX, stake=_SHARE, pays="harville", min_payout=45.0, dark_horse=5, fixed_fraction=0.01),
    "v10_2": Spec("box", pays="actual", rake=P.RAKE_PAIR),
    "v14": Spec("banker", pays="hits", min_p=0.4), "v16": Spec("banker", pays="hits", min_p=0.4),
    "v17": Spec("banker", Stake("rounded", start=10_000.0, minimum=20.0, ruin=20.0), pays="fixed", min_p=0.4, fixed_fraction=_kelly(BANKER_HITS, BANKER_ODDS, 0.25)),
    "v18": Spec("wheel", pays="hits"),
    "v19": Spec("wheel", Stake("rounded", minimum=10.0, cap=300_000.0, ruin=120.0), pays="fixed", fixed_fraction=_kelly(WHEEL_HITS, WHEEL_ODDS, 0.25)),
    "v22": Spec("wheel", _WHEEL, pays="fixed", p="regime", mult=0.1),
    "v23": Spec("wheel", _WHEEL, pays="raw", p="regime", mult=0.1, rake=P.RAKE_PAIR),
    "v24": Spec("wheel", _WHEEL, pays="harville", p="regime", mult=0.1, rake=P.RAKE_PAIR, min_field=5, min_ev=1.15, guard="cap"),
    "v25": Spec("trio", _TRIO, pays="harville", p="regime", mult=0.1, min_field=5, min_ev=1.05, per_ticket=True, guard="cap"),
    "v26": Spec("sweep", _SWEEP, pays="harville", p="top", top=35, min_field=7, mult=0.1, min_ev=1.05),
    "v27": Spec("sweep", _SWEEP, pays="harville", p="place", min_field=7, mult=0.1, min_ev=1.05),
    "v28": Spec("sweep", _SWEEP, pays="harville", min_field=7, mult=0.1, min_ev=1.05),
    "v29": Spec("sweep", _SWEEP, pays="harville", min_field=7, mult=0.1, min_ev=1.05, min_p=0.01),
    "v30": Spec("trio", _TRIO, pays="harville", min_field=7, mult=0.1, min_ev=1.05, per_ticket=True),
    "v31": Spec("trio", _TRIO, pays="harville", min_field=7, mult=0.05, min_ev=1.05, per_ticket=True),
    "v32": Spec("trio", Stake("rounded", minimum=10.0, least_risk=60.0, within=True), pays="actual", min_field=7, mult=0.05, min_ev=1.05, guard="skip"),
}

ANCHOR_ODDS, LEG_ODDS, LEGS, BANKER_LEAST, SWEEP = 5.0, 7.0, 4, 7.0, 7


def prepared(scored: DataFrame, spec: Spec) -> DataFrame:
    """Entries with ranks by model and public, q (the market's probability) and the field's size, of large enough fields."""
    return H.min_field(H.share(H.public_rank(H.rank_in_contest(scored, "score")), 1 / F.col("odds"), "q"), spec.min_field)


def tickets(scored: DataFrame, spec: Spec, payouts: DataFrame | None = None) -> DataFrame:
    """season, d, contest, k, n, fraction, odds, won: what the strategy bets on, see `ledger.fold`.

    scored: entries with score and p (probabilities that add up to 1 in a contest), and meta or place where the spec
    takes these. Contests without enough entries for the kind give no tickets. payouts: contest, combo (a sorted array of
    participants' numbers) and dividend (for 10 of stake); a trio that pays actually wins what its number sets are paid,
    those of a dead heat added up. Without payouts it wins the contest's payout by positions.
    """
    if spec.kind == "trio" and spec.pays == "actual" and payouts is not None:
        out = _anchored(prepared(scored, spec), spec, payouts)
        return out.select("season", "d", "contest", F.col("k").cast("int"), F.col("n").cast("int"), F.round("fraction", 9).alias("fraction"), F.round("odds", 6).alias("odds"), "won")
    make = {"single": _single, "box": _box, "banker": _banker, "wheel": _anchored, "trio": _anchored, "sweep": _sweep}[spec.kind]
    out = make(prepared(scored, spec), spec)
    # Rounded, so that gates and stakes don't hang on the last bit.
    return out.select("season", "d", "contest", F.col("k").cast("int"), F.col("n").cast("int"), F.round("fraction", 9).alias("fraction"), F.round("odds", 6).alias("odds"), "won")


def _single(e: DataFrame, spec: Spec) -> DataFrame:
    share, left = P.kelly(F.col(spec.p), F.col("odds"), spec.mult), F.lit(spec.cap)
    e = e.where((F.col("model_rank") <= spec.top) & (F.col("public_rank") >= spec.min_public_rank))
    if spec.top > 1:  # the contest's bets use up the cap in the order of rank
        before = H.contest_window().orderBy("model_rank").rowsBetween(Window.unboundedPreceding, -1)
        left = F.greatest(F.lit(0.0), left - F.coalesce(F.sum(share).over(before), F.lit(0.0)))
    return e.withColumns({"k": F.col("model_rank"), "n": F.lit(1), "fraction": F.least(share, left), "won": (F.col("position") == 1).cast("int")})


def _box(e: DataFrame, spec: Spec) -> DataFrame:
    """One ticket of three pairs, or, where pairs must be worth their while, a ticket for each."""
    e = e.where("model_rank <= 3").withColumn("far", F.max("public_rank").over(H.contest_window())).where(F.col("far") >= spec.dark_horse)
    both = combos(e, 2, ["model_rank", "position", "q"], "model_rank").join(e.groupBy("season", "d", "contest").agg(F.max("payout").alias("payout"), F.count("*").alias("picks")).where("picks = 3"), "contest")
    pay = F.col("payout") / 10 if spec.pays == "actual" else P.synthetic_odds(P.harville_pair(F.col("q_1"), F.col("q_2")), spec.rake)
    both = both.withColumns({"pay": pay, "won": ((F.col("position_1") <= 2) & (F.col("position_2") <= 2)).cast("int")})
    if spec.stake.how == "flat":
        priced = F.lit(None).cast("double") if spec.pays == "hits" else F.max(F.when(F.col("won") == 1, F.col("pay")))
        return both.groupBy("season", "d", "contest").agg(priced.alias("odds"), F.max("won").alias("won")).withColumns({"k": F.lit(1), "n": F.lit(3), "fraction": F.lit(0.0)})
    fraction = P.value_stake(F.col("pay") * 10, spec.min_payout) if spec.value_stakes else F.lit(spec.fixed_fraction)
    return both.where(F.round(F.col("pay") * 10, 9) >= spec.min_payout).withColumns({"k": F.col("model_rank_1") * 10 + F.col("model_rank_2"), "n": F.lit(1), "fraction": fraction, "odds": F.col("pay")})


def _banker(e: DataFrame, spec: Spec) -> DataFrame:
    bank = e.where((F.col("odds") >= BANKER_LEAST) & (F.round("place", 9) >= spec.min_p)).groupBy("season", "d", "contest").agg(F.min_by("participant", "model_rank").alias("banker"), F.min_by("position", "model_rank").alias("banker_position"))
    legs = e.join(bank.select("contest", "banker", "banker_position"), "contest").where("participant <> banker")
    legs = H.rank_in_contest(legs, "odds", "first", False, "leg").where("leg <= 2").groupBy("season", "d", "contest").agg(F.count("*").alias("legs"), F.max((F.col("position") <= 2).cast("int")).alias("hit"), F.first("banker_position").alias("at"))
    out = legs.where("legs = 2").withColumns({"k": F.lit(1), "won": ((F.col("at") <= 2) & (F.col("hit") == 1)).cast("int"), "fraction": F.lit(spec.fixed_fraction or 0.0)})
    fixed = spec.pays == "fixed"  # then the ticket is staked as a whole
    return out.withColumns({"n": F.lit(1 if fixed else 2), "odds": F.lit(BANKER_ODDS if fixed else None).cast("double")})


def regime_hits(distance: Column) -> Column:
    regime = distance_regime(distance)
    return reduce(lambda c, x: c.when(regime == x[0], F.lit(x[1])), list(REGIME_HITS.items())[1:], F.when(regime == "Mile", F.lit(REGIME_HITS["Mile"])))


def _anchored(e: DataFrame, spec: Spec, payouts: DataFrame | None = None) -> DataFrame:
    """One ticket over twelve ordered or six unordered combinations of the top pick with two of four legs."""
    ordered = spec.kind == "wheel"
    anchor = e.where((F.col("model_rank") == 1) & (F.col("odds") <= ANCHOR_ODDS)).withColumn("anchor", F.lit(1))
    legs = e.where((F.col("model_rank") > 1) & (F.col("odds") >= LEG_ODDS))
    legs = legs.withColumn("leg", F.row_number().over(H.contest_window().orderBy("model_rank"))).where(F.col("leg") <= LEGS).drop("leg").withColumn("anchor", F.lit(0))
    three = combos(anchor.unionByName(legs), 3, ["participant", "position", "p", "q", "odds"], "model_rank", anchor="anchor", ordered=ordered)
    price = P.harville_ordered if ordered else P.harville_trio
    own = [F.col(f"p_{k}") for k in (1, 2, 3)]
    if spec.pays == "raw":  # of odds that add up to more than 1, kept within bounds
        a, b, c = (1 / F.col(f"odds_{k}") for k in (1, 2, 3))
        market = F.least(F.greatest(a * (b / (1 - a)) * (c / (1 - a - b)), F.lit(1e-5)), F.lit(0.99))
    else:
        market = price(*[F.col(f"q_{k}") for k in (1, 2, 3)], guard=spec.guard)
    three = three.withColumns({"hit": price(*own, guard=spec.guard), "pay": P.synthetic_odds(market, spec.rake)})
    n = LEGS * (LEGS - 1) // (1 if ordered else 2)
    if payouts is not None:
        three = settle_bets(three.withColumns({"combo": F.array_sort(F.array(*[F.col(f"participant_{k}") for k in (1, 2, 3)])), "stake": F.lit(1.0)}), payouts.withColumn("combo", F.col("combo").cast("array<bigint>")))
    paid = [] if payouts is None else [F.sum("returned").alias("paid"), F.max("won").alias("set_won")]
    both = F.max(((F.col("position_2") <= 3) & (F.col("position_3") <= 3)).cast("int"))
    block = three.groupBy("contest").agg(F.count("*").alias("n"), F.sum("hit").alias("hit"), F.avg("pay").alias("pay"), F.max("position_1").alias("at"), both.alias("legs"), *paid).where(F.col("n") == n)
    head = e.groupBy("season", "d", "contest").agg(F.max("payout").alias("payout"), F.max("distance").alias("distance"))
    block = block.join(head, "contest").withColumn("won", ((F.col("at") <= (1 if ordered else 3)) & (F.col("legs") == 1)).cast("int"))
    if payouts is not None:
        block = block.withColumns({"won": F.col("set_won"), "payout": F.col("paid") * 10})
    odds = {"hits": F.lit(None).cast("double"), "fixed": F.lit(WHEEL_ODDS), "actual": F.col("payout") / 10}.get(spec.pays, F.col("pay"))
    p = regime_hits(F.col("distance")) if spec.p == "regime" else F.col("hit")
    expected = F.lit(WHEEL_ODDS) if spec.pays == "fixed" else F.col("pay") / (n if spec.per_ticket or ordered else 1)
    fraction = F.lit(spec.fixed_fraction) if spec.fixed_fraction is not None else P.kelly(p, expected, spec.mult)
    if spec.pays == "hits":
        fraction = F.lit(0.0)
    block = block.where(F.round(p * expected, 9) >= spec.min_ev) if spec.min_ev else block
    return block.withColumns({"k": F.lit(1), "fraction": fraction, "odds": odds})


def _sweep(e: DataFrame, spec: Spec) -> DataFrame:
    """A ticket for each of the best triples of the top seven."""
    if spec.p == "place":
        e = H.share(e, F.col("place"), "own")
    e = e.where(F.col("model_rank") <= SWEEP)
    e = H.share(e, F.col("p"), "own") if spec.p == "top" else e if spec.p == "place" else e.withColumn("own", F.col("p"))
    three = combos(e, 3, ["position", "own", "q", "model_rank", "season", "d"], "model_rank").withColumnsRenamed({"season_1": "season", "d_1": "d"})
    hit, market = (P.harville_trio(*[F.col(f"{c}_{k}") for k in (1, 2, 3)], guard=spec.guard) for c in ("own", "q"))
    # By inline, as the optimizer would spell both prices out again in each gate and stake below.
    three = three.select("*", F.inline(F.array(F.struct(hit.alias("hit"), market.alias("market"))))).withColumn("pay", P.synthetic_odds(F.col("market"), spec.rake))
    three = three.where((F.round(F.col("hit") * F.col("pay"), 9) >= spec.min_ev) & (F.round("hit", 9) >= spec.min_p)).withColumn("fraction", F.round(P.kelly(F.col("hit"), F.col("pay"), spec.mult), 9)).where("fraction > 0")
    order = H.contest_window().orderBy(F.desc("fraction"), *[f"model_rank_{k}" for k in (1, 2, 3)])
    best = three.withColumn("k", F.row_number().over(order)).where(F.col("k") <= spec.top)
    won = sum(((F.col(f"position_{k}") <= 3).cast("int") for k in (1, 2, 3)), F.lit(0)) == 3
    return best.withColumns({"n": F.lit(1), "odds": F.col("pay"), "won": won.cast("int")})


def run_strategy(scored: DataFrame, spec: Spec, payouts: DataFrame | None = None) -> DataFrame:
    """A row a contest that is bet on, with the bankroll after it; every season starts anew."""
    return plain(fold(tickets(scored, spec, payouts).withColumn("config", F.lit("")), spec.stake)).drop("config")


def strategy_seasons(scored: DataFrame, spec: Spec, payouts: DataFrame | None = None) -> DataFrame:
    """Per season: contests, hits, roi, growth, low, break_even."""
    steps = fold(tickets(scored, spec, payouts).withColumn("config", F.lit("")), spec.stake)
    return season_ledger(steps, spec.stake.start, spec.pays != "hits", spec.stake.how == "flat").drop("config")


def regime_desk(scored: DataFrame) -> DataFrame:
    """Per distance regime: entries and the Brier score of place, and executions and hit rate of the ordered wheel."""
    e = prepared(scored, SPECS["v18"]).withColumn("regime", distance_regime(F.col("distance")))
    placed = (F.col("position") <= 3).cast("double")
    rows = e.groupBy("regime").agg(F.count("*").alias("rows"), F.round(F.avg((F.col("place") - placed) * (F.col("place") - placed)), 6).alias("brier"))
    runs = tickets(scored, SPECS["v18"]).join(e.select("contest", "regime").distinct(), "contest").groupBy("regime").agg(F.count("*").alias("executions"), F.round(F.avg(F.col("won").cast("double")), 6).alias("hit_rate"))
    return rows.join(runs, "regime", "left").fillna(0, ["executions"])
