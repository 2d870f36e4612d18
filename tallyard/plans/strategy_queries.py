"""Queries of the strategies; the SQL spells their picks, prices and stakes out again."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import functions as F

from tallyard.functions.scalars import clean_combo
from tallyard.operators import history as H
from tallyard.operators import strategies as S
from tallyard.plans.analogue import entries, with_entries
from tallyard.plans.market_queries import FORM, RANKED
from tallyard.registry import query

# Calibrations stand in for fitted ones: fixed logistic curves of the score, the same in SQL.
PLACE, META = "1 / (1 + exp(-(2 * score - 1)))", "1 / (1 + exp(-(1.5 * score + 1 / odds - 1.5)))"


def calibrated(spark, sf):
    """Entries with a fixed linear score that leans to short odds, its softmax p, and probabilities to place and a second one to win."""
    e = H.rolling_mean(entries(spark, sf), "participant", "discount", 5, "form")
    e = e.withColumn("score", F.round(F.coalesce(F.round("form", 6), F.lit(0.05)) * 10 + (50 - F.col("weight")) / 100, 6))
    return H.softmax(e, "score", "p").withColumns({"place": F.expr(PLACE), "meta": F.expr(META)})


_SCORED = f"SC AS (SELECT *, exp(score) / sum(exp(score)) OVER (PARTITION BY contest) AS p FROM (SELECT *, round(coalesce(round({FORM}, 6), 0.05) * 10 + (50 - weight) / 100, 6) AS score FROM E)), {RANKED}"


def sql(body: str, more: str) -> str:
    return with_entries(body, f"{_SCORED}, {more}")


def payouts(spark, sf):
    """contest, combo, dividend: what trios are paid, out of rows of several pools, combinations as text; every 17th contest
    has a dead heat for third place, and some rows name no trio."""
    e = entries(spark, sf)
    at = lambda k: F.max(F.when(F.col("position") == k, F.col("participant"))).cast("string")
    first = e.groupBy("contest").agg(*[at(k).alias(f"p{k}") for k in (1, 2, 3, 4)], F.max("payout").alias("dividend")).where("p3 IS NOT NULL")
    row = lambda pool, combo, dividend: F.struct(F.lit(pool).alias("pool"), combo.alias("combo"), dividend.alias("dividend"))
    dead = F.when((F.col("contest") % 17 == 0) & F.col("p4").isNotNull(), F.concat_ws(",", "p4", "p1", "p2"))
    rows = F.array(row("TRIO", F.concat_ws(",", "p3", "p1", "p2"), F.col("dividend")), row("TRIO", dead, F.col("dividend") / 2), row("TRIO", F.concat_ws("/", "p1", "p2"), F.col("dividend")), row("QUINELLA", F.concat_ws(",", "p1", "p2"), F.col("dividend")))
    rows = first.select("contest", F.explode(rows).alias("x")).select("contest", "x.*")
    return rows.where("pool = 'TRIO'").select("contest", clean_combo(F.col("combo")).alias("combo"), "dividend").where("combo IS NOT NULL")


_PAYS = """PY AS (SELECT contest, list_sort(list(participant) FILTER (position <= 3)) AS combo, max(payout) AS dv FROM E GROUP BY contest HAVING count(*) FILTER (position <= 3) = 3
  UNION ALL SELECT contest, list_sort(list(participant) FILTER (position IN (1, 2, 4))), max(payout) / 2 FROM E WHERE contest % 17 = 0 GROUP BY contest HAVING count(*) FILTER (position IN (1, 2, 4)) = 3)"""

_RS = f"RS AS (SELECT *, {PLACE} AS place, {META} AS meta, count(*) OVER (PARTITION BY contest) AS field FROM RK)"
_WON2 = "CAST(a.position <= 2 AND b.position <= 2 AS INTEGER)"


def _kelly(p: str, odds: str, mult: float) -> str:
    return f"CASE WHEN {odds} > 1 THEN greatest(0, (({odds} - 1) * {p} - (1 - {p})) / ({odds} - 1) * {mult}::DOUBLE) ELSE 0 END"


def _single(s: S.Spec) -> str:
    share = _kelly(s.p, "odds", s.mult)
    before = f"coalesce(sum({share}) OVER (PARTITION BY contest ORDER BY model_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)" if s.top > 1 else "0"
    return f"SELECT season, d, contest, model_rank AS k, least({share}, greatest(0, {s.cap}::DOUBLE - {before})) AS f, odds AS o, CAST(position = 1 AS INTEGER) AS w FROM RS WHERE model_rank <= {s.top} AND public_rank >= {s.min_public_rank} AND field >= {s.min_field}"


def _box(s: S.Spec) -> str:
    pay = "a.payout / 10" if s.pays == "actual" else f"{1 - s.rake}::DOUBLE / (a.q * b.q / (1 - a.q) + b.q * a.q / (1 - b.q))"
    top = f"(SELECT *, max(public_rank) OVER (PARTITION BY contest) AS far, count(*) OVER (PARTITION BY contest) AS picks FROM RS WHERE model_rank <= 3 AND field >= {s.min_field})"
    rows = f"SELECT a.season, a.d, a.contest, a.model_rank * 10 + b.model_rank AS k, {pay} AS pay, {_WON2} AS w FROM {top} a JOIN {top} b ON b.contest = a.contest AND b.model_rank > a.model_rank WHERE a.picks = 3 AND a.far >= {s.dark_horse}"
    if s.stake.how == "flat":
        return f"SELECT season, d, contest, 1 AS k, 0 AS f, {'NULL' if s.pays == 'hits' else 'max(pay) FILTER (w = 1)'} AS o, max(w) AS w FROM ({rows}) GROUP BY season, d, contest"
    f = f"least(0.01 * (pay * 10) / {s.min_payout}, 0.035)" if s.value_stakes else str(s.fixed_fraction)
    return f"SELECT season, d, contest, k, {f} AS f, pay AS o, w FROM ({rows}) WHERE round(pay * 10, 9) >= {s.min_payout}"


def _banker(s: S.Spec) -> str:
    fixed = s.pays == "fixed"
    bank = f"(SELECT contest, min_by(participant, model_rank) AS banker, min_by(position, model_rank) AS spot FROM RS WHERE odds >= 7 AND round(place, 9) >= {s.min_p} GROUP BY contest)"
    legs = f"SELECT *, row_number() OVER (PARTITION BY contest ORDER BY odds, participant) AS leg FROM (SELECT RS.*, spot FROM RS JOIN {bank} b ON b.contest = RS.contest AND b.banker <> RS.participant)"
    return f"SELECT season, d, contest, 1 AS k, {s.fixed_fraction or 0} AS f, {S.BANKER_ODDS if fixed else 'NULL'} AS o, CAST(max(spot) <= 2 AND max(CAST(position <= 2 AS INTEGER)) = 1 AS INTEGER) AS w FROM ({legs}) WHERE leg <= 2 GROUP BY season, d, contest HAVING count(*) = 2"


def _ordered(p: str, r=("a", "b", "c")) -> str:
    a, b, c = (f"{x}.{p}" for x in r)
    return f"{a} * {b} / (1 - {a}) * {c} / (1 - {a} - {b})"


def _trio(p: str) -> str:
    return "(" + " + ".join(_ordered(p, r) for r in permutations("abc")) + ")"


def _anchored(s: S.Spec, sets: bool = False) -> str:
    ordered = s.kind == "wheel"
    n, price = (12, _ordered) if ordered else (6, _trio)
    market = "least(greatest(1 / a.odds * (1 / b.odds / (1 - 1 / a.odds)) * (1 / c.odds / (1 - 1 / a.odds - 1 / b.odds)), 0.00001), 0.99)" if s.pays == "raw" else price("q")
    legs = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contest ORDER BY model_rank) AS leg FROM RS WHERE model_rank > 1 AND odds >= 7 AND field >= {s.min_field}) WHERE leg <= 4)"
    rows = f"SELECT a.season, a.d, a.contest, a.payout, a.distance, a.position AS spot, {price('p')} AS hit, {1 - s.rake}::DOUBLE / ({market}) AS pay, CAST(b.position <= 3 AND c.position <= 3 AS INTEGER) AS legs, {'(SELECT sum(dv) FROM PY WHERE PY.contest = a.contest AND PY.combo = list_sort([a.participant, b.participant, c.participant]))' if sets else 'NULL::DOUBLE'} AS dv FROM RS a JOIN {legs} b ON b.contest = a.contest JOIN {legs} c ON c.contest = a.contest AND c.model_rank {'<>' if ordered else '>'} b.model_rank WHERE a.model_rank = 1 AND a.odds <= 5 AND a.field >= {s.min_field}"
    won = "CAST(count(dv) > 0 AS INTEGER)" if sets else f"CAST(max(spot) <= {1 if ordered else 3} AND max(legs) = 1 AS INTEGER)"
    block = f"SELECT season, d, contest, {'coalesce(sum(dv), 0)' if sets else 'max(payout)'} AS payout, max(distance) AS distance, sum(hit) AS hit, avg(pay) AS pay, {won} AS w FROM ({rows}) GROUP BY season, d, contest HAVING count(*) = {n}"
    p = "CASE WHEN distance <= 1200 THEN 0.055276 WHEN distance <= 1650 THEN 0.077748 ELSE 0.07 END::DOUBLE" if s.p == "regime" else "hit"
    expected = "250.0::DOUBLE" if s.pays == "fixed" else f"pay / {n}" if ordered or s.per_ticket else "pay"
    f = "0" if s.pays == "hits" else str(s.fixed_fraction) if s.fixed_fraction is not None else _kelly("pr", "ex", s.mult)
    odds = {"hits": "NULL", "fixed": "250.0::DOUBLE", "actual": "payout / 10"}.get(s.pays, "pay")
    return f"SELECT season, d, contest, 1 AS k, {f} AS f, {odds} AS o, w FROM (SELECT *, {p} AS pr, {expected} AS ex FROM ({block})) WHERE round(pr * ex, 9) >= {s.min_ev or -1}"


def _sweep(s: S.Spec) -> str:
    own = {"place": "place / sum(place) OVER (PARTITION BY contest)", "top": "p"}.get(s.p, "p")
    seven = f"SELECT * FROM (SELECT *, {own} AS own FROM RS WHERE field >= {s.min_field}) WHERE model_rank <= 7"
    if s.p == "top":
        seven = f"SELECT * REPLACE (own / sum(own) OVER (PARTITION BY contest) AS own) FROM ({seven})"
    rows = f"SELECT a.season, a.d, a.contest, a.model_rank AS ra, b.model_rank AS rb, c.model_rank AS rc, {_trio('own')} AS hit, {1 - s.rake}::DOUBLE / {_trio('q')} AS pay, CAST(a.position <= 3 AND b.position <= 3 AND c.position <= 3 AS INTEGER) AS w FROM ({seven}) a JOIN ({seven}) b ON b.contest = a.contest AND b.model_rank > a.model_rank JOIN ({seven}) c ON c.contest = a.contest AND c.model_rank > b.model_rank"
    best = f"SELECT *, row_number() OVER (PARTITION BY contest ORDER BY f DESC, ra, rb, rc) AS k FROM (SELECT *, round({_kelly('hit', 'pay', s.mult)}, 9) AS f FROM ({rows}) WHERE round(hit * pay, 9) >= {s.min_ev} AND round(hit, 9) >= {s.min_p}) WHERE f > 0"
    return f"SELECT season, d, contest, k, f, pay AS o, w FROM ({best}) WHERE k <= {s.top}"


_MAKE = {"single": _single, "box": _box, "banker": _banker, "wheel": _anchored, "trio": _anchored, "sweep": _sweep}
_N = {"single": 1, "wheel": 12, "trio": 6, "sweep": 1}


def _stake(s: S.Spec, n: int) -> str:
    """What is staked on each combination, from the bankroll s.bank and the ticket t."""
    k = s.stake
    if k.how == "flat":
        return f"{k.amount}::DOUBLE"
    if k.how == "share":
        return f"(s.bank * t.f / {n})"
    each = f"greatest({k.minimum}::DOUBLE, round_even(s.bank * t.f / {n} / {k.unit}, 0) * {k.unit})"
    if k.cap:
        each = f"CASE WHEN {each} * {n} > {k.cap} THEN round_even({k.cap}::DOUBLE / {n} / {k.unit}, 0) * {k.unit} ELSE {each} END"
    rules = [f"s.bank <= {k.ruin}"] * (k.ruin > 0) + [f"s.bank * t.f < {k.least_risk}"] * (k.least_risk > 0) + [f"({each}) * {n} < {k.least}"] * (k.least > 0) + [f"({each}) * {n} > s.bank"] * k.within
    return f"CASE WHEN {' OR '.join(rules) or 'false'} THEN 0 ELSE {each} END"


def strategy_sql(s: S.Spec, sets: bool = False) -> str:
    n = _N.get(s.kind) or (1 if s.stake.how == "share" or s.pays == "fixed" else 3 if s.kind == "box" else 2)
    stake = _stake(s, n)
    total = lambda what: f"list_sum(list_transform(x.ts, lambda t: ({what})))"
    staked, paid = total(f"({stake}) * {n}"), total(f"({stake}) * t.w * coalesce(t.o, 0)")
    hit = f"list_max(list_transform(x.ts, lambda t: CASE WHEN ({stake}) > 0 THEN t.w ELSE 0 END))"
    step = f"{{'d': x.d, 'contest': x.contest, 'ts': x.ts, 'bank': s.bank - {staked} + {paid}, 'low': least(s.low, s.bank - {staked} + {paid}), 'n': s.n + CAST({staked} > 0 AS BIGINT), 'hits': s.hits + {hit}, 'staked': s.staked + {staked}, 'returned': s.returned + {paid}}}"
    zero = f"'bank': {s.stake.start}::DOUBLE, 'low': {s.stake.start}::DOUBLE, 'n': 0::BIGINT, 'hits': 0::BIGINT, 'staked': 0::DOUBLE, 'returned': 0::DOUBLE"
    made = _anchored(s, True) if sets else _MAKE[s.kind](s)
    more = f"""{_RS}, {_PAYS}, TK AS (SELECT season, d, contest, k, round(f, 9)::DOUBLE AS f, round(o, 6)::DOUBLE AS o, w::BIGINT AS w FROM ({made})),
CN AS (SELECT season, d, contest, list({{'f': f, 'o': o, 'w': w}} ORDER BY k) AS ts FROM TK GROUP BY season, d, contest),
FD AS (SELECT season, list_reduce(list_concat([{{'d': NULL::DATE, 'contest': NULL::BIGINT, 'ts': NULL::STRUCT(f DOUBLE, o DOUBLE, w BIGINT)[], {zero}}}], list({{'d': d, 'contest': contest, 'ts': ts, {zero}}} ORDER BY d, contest)), lambda s, x: {step}) AS r FROM CN GROUP BY season)"""
    priced = s.pays != "hits"
    if_priced = lambda c: c if priced else "NULL::DOUBLE"
    start = f"{s.stake.start}::DOUBLE"
    growth = f"round(CASE WHEN r.bank > 0 THEN ln(r.bank / {start}) END, 6)"
    even = "round(r.staked / nullif(r.hits, 0), 4)" if s.stake.how == "flat" else "NULL::DOUBLE"
    return sql(f"SELECT season, r.n AS contests, r.hits AS hits, {if_priced('round(r.returned / r.staked - 1, 6)')} AS roi, {if_priced(growth)} AS growth, {if_priced(f'round(r.low / {start}, 6)')} AS low, {even} AS break_even FROM FD WHERE r.n > 0", more)


def _register(name: str, spec: S.Spec) -> None:
    sets = name == "v32"  # settled against the number sets that are paid

    @query(strategy_sql(spec, sets), name=f"strategy_{name}")
    def run(spark, sf):
        return S.strategy_seasons(calibrated(spark, sf), spec, payouts(spark, sf) if sets else None)


for _name, _spec in S.SPECS.items():
    _register(_name, _spec)


_V18 = _anchored(S.SPECS["v18"])
_REGIME = "CASE WHEN distance <= 1200 THEN 'Sprint' WHEN distance <= 1650 THEN 'Mile' ELSE 'Stayer' END"


@query(sql(f"SELECT a.regime, rows, brier, coalesce(executions, 0) AS executions, hit_rate FROM (SELECT {_REGIME} AS regime, count(*) AS rows, round(avg(pow(place - CAST(position <= 3 AS DOUBLE), 2)), 6) AS brier FROM RS GROUP BY 1) a LEFT JOIN (SELECT {_REGIME} AS regime, count(*) AS executions, round(avg(CAST(w AS DOUBLE)), 6) AS hit_rate FROM ({_V18}) t JOIN (SELECT contest AS c, max(distance) AS distance FROM RS GROUP BY 1) m ON m.c = t.contest GROUP BY 1) b ON b.regime = a.regime", _RS), name="strategy_v21")
def strategy_v21(spark, sf):
    return S.regime_desk(calibrated(spark, sf))
