"""Queries of pricing, ledgers, sweeps, diagnostics and strategies."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyard.functions import pricing as P
from tallyard.functions.scalars import distance_regime
from tallyard.operators import history as H
from tallyard.operators import market as M
from tallyard.plans.analogue import entries, with_entries
from tallyard.plans.feature_queries import _HISTORY
from tallyard.registry import query

FORM = "avg(discount) OVER (PARTITION BY participant ORDER BY d, contest, participant ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
RANKED = """RK AS (SELECT *, row_number() OVER (PARTITION BY contest ORDER BY score DESC, participant) AS model_rank, rank() OVER (PARTITION BY contest ORDER BY odds) AS public_rank,
  row_number() OVER (PARTITION BY contest ORDER BY odds, participant) AS market_rank, (1 / odds) / sum(1 / odds) OVER (PARTITION BY contest) AS q FROM SC)"""
SCORED = f"SC AS (SELECT *, exp(score) / sum(exp(score)) OVER (PARTITION BY contest) AS p FROM (SELECT *, round(coalesce(round({FORM}, 6), 0.05) * 10 + weight / 100, 6) AS score FROM E)), {RANKED}"


def sql(body: str, more: str = "") -> str:
    return with_entries(body, SCORED + (", " + more if more else ""))


def scored(spark, sf) -> DataFrame:
    """Entries with a fixed linear score of form and weight, and its softmax p."""
    e = H.rolling_mean(entries(spark, sf), "participant", "discount", 5, "form")
    e = e.withColumn("score", F.round(F.coalesce(F.round("form", 6), F.lit(0.05)) * 10 + F.col("weight") / 100, 6))
    return H.softmax(e, "score", "p")


def ranked(spark, sf) -> DataFrame:
    return H.share(H.public_rank(H.rank_in_contest(scored(spark, sf), "score")), 1 / F.col("odds"), "q")


_DIAG = """DG AS (SELECT contest, season, CAST(mp = 1 AS INTEGER) AS m_top1_win, CAST(pp = 1 AS INTEGER) AS p_top1_win, CAST(mp <= 3 AS INTEGER) AS m_top1_place, CAST(pp <= 3 AS INTEGER) AS p_top1_place,
 CAST(list_sort(m3) = list_sort(a3) AS INTEGER) AS m_top3_exact, CAST(list_sort(p3) = list_sort(a3) AS INTEGER) AS p_top3_exact, CAST(len(list_intersect(m3, a3)) AS INTEGER) AS m_overlap, CAST(len(list_intersect(p3, a3)) AS INTEGER) AS p_overlap,
 CAST(m1 <> p1 AS INTEGER) AS diverge, CASE WHEN m1 <> p1 THEN CAST(mp < pp AS INTEGER) END AS m_beats_p
FROM (SELECT contest, season, list(participant) FILTER (model_rank <= 3) AS m3, list(participant) FILTER (market_rank <= 3) AS p3, list(participant) FILTER (position <= 3) AS a3, max(position) FILTER (model_rank = 1) AS mp, max(position) FILTER (market_rank = 1) AS pp, max(participant) FILTER (model_rank = 1) AS m1, max(participant) FILTER (market_rank = 1) AS p1 FROM RK GROUP BY contest, season))"""


@query(sql("SELECT * FROM DG", _DIAG))
def a19_ranking_diagnostics(spark, sf):
    return M.ranking_diagnostics(scored(spark, sf))


_MEANS = "SELECT *, round(m_top1_win - p_top1_win, 6) AS edge FROM (SELECT season, count(*) AS contests, " + ", ".join(
    f"round(avg({c}), 6) AS {c}" for c in ("m_top1_win", "p_top1_win", "m_top1_place", "p_top1_place", "m_top3_exact", "p_top3_exact", "m_overlap", "p_overlap", "diverge", "m_beats_p")
) + " FROM DG GROUP BY ROLLUP (season))"


def _cuts():
    total, p, out = 0.0, math.exp(-1), []
    for k in range(8):
        total += p
        out.append(total)
        p /= k + 1
    return out


_W = " + ".join(f"CAST(u > {c!r}::DOUBLE AS INTEGER)" for c in _cuts())


def _boot(rows: str, reps: int) -> str:
    """BC: grp, mean, low, high. rows gives grp, k and x."""
    number = "CAST(('0x' || substr({}, {}, 8)) AS BIGINT)"
    return f"""BK AS MATERIALIZED (SELECT grp, {number.format("md5(k::VARCHAR)", 1)} % 1024 AS bucket, sum(x)::DOUBLE AS x, count(*) AS n FROM ({rows}) GROUP BY 1, 2),
BH AS MATERIALIZED (SELECT bucket, g, md5(bucket || ':' || g || ':42') AS mark FROM range(1024) b(bucket), range({reps // 4}) r(g)),
BW AS MATERIALIZED (SELECT bucket, g * 4 + j AS rep, {_W} AS w FROM (SELECT *, ({number.format("mark", "1 + 8 * j")} + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u FROM BH, range(4) q(j))),
BS AS MATERIALIZED (SELECT grp, rep, sum(x * w) AS s, sum(n * w) AS n FROM BK JOIN BW ON BW.bucket = BK.bucket GROUP BY grp, rep),
BM AS (SELECT grp, rep, s / n AS m FROM BS UNION ALL SELECT NULL, rep, sum(s) / sum(n) FROM BS GROUP BY rep),
BC AS (SELECT grp, round(avg(m), 4) AS mean, round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high FROM BM GROUP BY grp)"""


@query(sql(f"SELECT r.*, low, high, CASE WHEN low > 0.5 THEN 'model' WHEN high < 0.5 THEN 'market' ELSE 'even' END AS verdict FROM ({_MEANS}) r LEFT JOIN BC ON BC.grp IS NOT DISTINCT FROM r.season", f"{_DIAG}, {_boot('SELECT season AS grp, contest AS k, m_beats_p AS x FROM DG WHERE m_beats_p IS NOT NULL', 2000)}"))
def a20_diagnostic_report(spark, sf):
    return M.diagnostic_report(M.ranking_diagnostics(scored(spark, sf)))


_TIERS = "SELECT tier, count(*) AS bets, count(*) FILTER (won) AS wins, round(100 * avg(CAST(won AS DOUBLE)), 4) AS win_pct, round(100 * (sum(CASE WHEN won THEN odds ELSE 0 END) / count(*) - 1), 4) AS roi_pct FROM (SELECT CAST(public_rank AS INTEGER) AS tier, position = 1 AS won, odds FROM RK WHERE model_rank = 1 AND public_rank <= 6) GROUP BY ROLLUP (tier)"


@query(sql(_TIERS))
def a11_tier_ledger(spark, sf):
    return M.tier_ledger(ranked(spark, sf))


_SEASON_SCORE = f"""{_HISTORY},
SC AS (SELECT *, exp(score) / sum(exp(score)) OVER (PARTITION BY contest) AS p FROM (SELECT *, round(coalesce(round(form, 6), 0.05) * 10 + weight / 100 + round(handler_rate, 6) + round(coalesce(form, 0) - pressure, 5) / 10, 6) AS score FROM FP)), {RANKED}"""
_FIRST = "FT1 AS (SELECT season, count(*) AS bets, round(avg(q), 6) AS mean_share, round(100 * (sum(CASE WHEN position = 1 THEN odds ELSE 0 END) / count(*) - 1), 4) AS roi_pct, count(*) FILTER (public_rank > 1) AS against FROM RK WHERE model_rank = 1 AND public_rank <= 6 GROUP BY ROLLUP (season))"


@query(with_entries(f"SELECT r.*, bets, mean_share, roi_pct, against FROM ({_MEANS}) r LEFT JOIN FT1 ON FT1.season IS NOT DISTINCT FROM r.season", f"{_SEASON_SCORE}, {_DIAG}, {_FIRST}"))
def flagship_season_report(spark, sf):
    """Does a score of form, handlers and the field's pressure beat the market, season by season, and what do its first picks return?"""
    e = H.pressure(H.handler_rate(H.rolling_mean(entries(spark, sf), "participant", "discount", 5, "form")), "form")
    score = F.coalesce(F.round("form", 6), F.lit(0.05)) * 10 + F.col("weight") / 100 + F.round("handler_rate", 6) + F.round("advantage", 5) / 10
    e = H.public_rank(H.share(H.rank_in_contest(e.withColumn("score", F.round(score, 6)), "score"), 1 / F.col("odds"), "q"))
    means = M.diagnostic_means(M.ranking_diagnostics(e))
    paid = F.sum(F.when(F.col("position") == 1, F.col("odds")).otherwise(0.0))
    first = e.where("model_rank = 1 AND public_rank <= 6").rollup(F.col("season").alias("_season")).agg(F.count("*").alias("bets"), F.round(F.avg("q"), 6).alias("mean_share"), F.round(100 * (paid / F.count("*") - 1), 4).alias("roi_pct"), F.count_if(F.col("public_rank") > 1).alias("against"))
    return means.join(first, F.col("season").eqNullSafe(F.col("_season")), "left").drop("_season")


def _bets(spark, sf):
    """A flat bet of 10 on each contest's first model pick."""
    e = ranked(spark, sf).where("model_rank = 1").withColumns({"staked": F.lit(10.0), "won": (F.col("position") == 1).cast("int")})
    return e.withColumn("returned", F.col("won") * F.col("odds") * 10)


_BETS = "BT AS (SELECT *, 10.0::DOUBLE AS staked, CAST(position = 1 AS INTEGER) AS won, CASE WHEN position = 1 THEN odds * 10 ELSE 0 END AS returned FROM RK WHERE model_rank = 1)"
_LEDGER = "count(*) AS bets, CAST(sum(won) AS BIGINT) AS hits, round(avg(won), 6) AS hit_rate, round(sum(staked), 2) AS staked, round(sum(returned), 2) AS returned, round(sum(returned) - sum(staked), 2) AS net, round((sum(returned) - sum(staked)) / sum(staked), 6) AS roi"


@query(sql(f"SELECT season, {_LEDGER} FROM BT GROUP BY season", _BETS))
def a9_flat_ledger(spark, sf):
    return M.flat_ledger(_bets(spark, sf), "season")


@query(sql("SELECT round(sum(staked) / sum(won), 6) AS break_even FROM BT", _BETS))
def a10_break_even(spark, sf):
    return M.break_even(_bets(spark, sf))


def _sweep_sql(where: str, other: str, values: str, value: str, hit: str) -> str:
    return f"SELECT floor, {other}, count(*) AS bets, count(*) FILTER ({hit}) AS hits, round(sum(CASE WHEN {hit} THEN odds * 10 ELSE 0 END) - count(*) * 10, 2) AS profit, round(sum(CASE WHEN {hit} THEN odds * 10 ELSE 0 END) / (count(*) * 10) - 1, 6) AS roi FROM RK JOIN (SELECT * FROM (VALUES (2.0::DOUBLE), (4.0::DOUBLE), (6.0::DOUBLE), (8.0::DOUBLE)) f(floor), (VALUES {values}) g({other})) ON odds >= floor AND {value} >= {other} WHERE {where} GROUP BY ALL"


@query(sql(_sweep_sql("model_rank = 1", "delta", "(0.013::DOUBLE), (0.057::DOUBLE), (0.103::DOUBLE)", "p - 1 / odds", "position = 1")))
def a12_sweep_odds_delta(spark, sf):
    return M.sweep_odds_delta(ranked(spark, sf), M.grid_of(spark, [2.0, 4.0, 6.0, 8.0], [0.013, 0.057, 0.103], "delta"))


@query(sql(_sweep_sql("model_rank <= 3", "threshold", "(0.113::DOUBLE), (0.217::DOUBLE), (0.331::DOUBLE)", "p", "position <= 3")))
def a13_sweep_odds_place(spark, sf):
    return M.sweep_odds_place(ranked(spark, sf), M.grid_of(spark, [2.0, 4.0, 6.0, 8.0], [0.113, 0.217, 0.331], "threshold"))


@query(sql("SELECT a.regime, rows, brier, executions, hit_rate FROM (SELECT regime, count(*) AS rows, round(avg((p - CAST(position = 1 AS DOUBLE)) * (p - CAST(position = 1 AS DOUBLE))), 6) AS brier FROM RG GROUP BY regime) a LEFT JOIN (SELECT regime, count(*) AS executions, round(avg(CAST(position = 1 AS DOUBLE)), 6) AS hit_rate FROM RG WHERE model_rank = 1 AND odds <= 5 GROUP BY regime) b ON a.regime = b.regime", "RG AS (SELECT *, CASE WHEN distance <= 1200 THEN 'Sprint' WHEN distance <= 1650 THEN 'Mile' ELSE 'Stayer' END AS regime FROM RK)"))
def a14_regime_report(spark, sf):
    return M.regime_report(ranked(spark, sf))


_CURVE = "CV AS (SELECT *, 10000 + sum(returned - staked) OVER (PARTITION BY season ORDER BY d, contest ROWS UNBOUNDED PRECEDING) AS bankroll FROM BT), DD AS (SELECT *, max(bankroll) OVER (PARTITION BY season ORDER BY d, contest ROWS UNBOUNDED PRECEDING) AS peak FROM CV)"


@query(sql("SELECT contest, round(bankroll, 4) AS bankroll FROM CV", f"{_BETS}, {_CURVE}"))
def w13_equity(spark, sf):
    b = _bets(spark, sf).withColumn("pnl", F.col("returned") - F.col("staked"))
    return H.equity(b, start=10_000.0).select("contest", F.round("bankroll", 4).alias("bankroll"))


_KELLY_CURVE = "KC AS (SELECT *, sum(ln(1 + least(p, 0.5) / 4 * (CASE WHEN position = 1 THEN odds ELSE 0 END - 1))) OVER (PARTITION BY season ORDER BY d, contest ROWS UNBOUNDED PRECEDING) AS growth FROM BT)"


@query(sql("SELECT contest, round(growth, 6) AS growth FROM KC", f"{_BETS}, {_KELLY_CURVE}"))
def w13_equity_kelly(spark, sf):
    """A quarter of p (up to one half) of the bankroll on each contest's first model pick, not rounded."""
    share = F.least(F.col("p"), F.lit(0.5)) / 4
    b = _bets(spark, sf).withColumn("r", share * (F.when(F.col("position") == 1, F.col("odds")).otherwise(0.0) - 1))
    return H.equity(b, "r", mode="kelly").select("contest", F.round("growth", 6).alias("growth"))


@query(sql("SELECT contest, round(peak, 4) AS peak, round((peak - bankroll) / peak, 6) AS drawdown FROM DD", f"{_BETS}, {_CURVE}"))
def w14_drawdown(spark, sf):
    b = _bets(spark, sf).withColumn("pnl", F.col("returned") - F.col("staked"))
    return H.drawdown(H.equity(b, start=10_000.0)).select("contest", F.round("peak", 4).alias("peak"), F.round("drawdown", 6).alias("drawdown"))


@query(sql("SELECT season, count(*) AS n, CAST(sum(won) AS BIGINT) AS wins, round(avg(won), 6) AS strike, round(sum(staked), 2) AS staked, round(sum(returned), 2) AS returned, round(sum(returned - staked), 2) AS net, round(sum(returned - staked) / sum(staked), 6) AS roi, round(avg((returned - staked) / staked) / stddev_pop((returned - staked) / staked), 6) AS sharpe, round(max((peak - bankroll) / peak), 6) AS max_drawdown, round(avg(CASE WHEN won = 1 THEN returned / staked END), 6) AS winning_odds FROM DD GROUP BY season", f"{_BETS}, {_CURVE}"))
def a15_season_summary(spark, sf):
    return M.season_summary(_bets(spark, sf))


@query(sql("SELECT count(*) AS bets, round(avg((returned - staked) / staked), 6) AS mean_return FROM BT", _BETS))
def a16_pooled(spark, sf):
    return M.pooled(_bets(spark, sf))


@query(sql("SELECT mean, low, high FROM BC WHERE grp IS NULL", f"{_BETS}, {_boot('SELECT season AS grp, contest AS k, won AS x FROM BT', 1000)}"))
def a17_bootstrap_ci(spark, sf):
    return M.bootstrap_ci(_bets(spark, sf).withColumn("won", F.col("won").cast("double")), "won", F.col("contest"), reps=1000)


# ---- pricing

_T3 = "T3 AS (SELECT contest, max(p) FILTER (model_rank = 1) AS p1, max(p) FILTER (model_rank = 2) AS p2, max(p) FILTER (model_rank = 3) AS p3, max(odds) FILTER (model_rank = 1) AS odds, max(payout) AS payout FROM RK GROUP BY contest HAVING count(*) >= 4)"


def _triples(spark, sf):
    at = lambda c, k: F.max(F.when(F.col("model_rank") == k, F.col(c)))
    g = ranked(spark, sf).groupBy("contest").agg(at("p", 1).alias("p1"), at("p", 2).alias("p2"), at("p", 3).alias("p3"), at("odds", 1).alias("odds"), F.max("payout").alias("payout"), F.count("*").alias("n"))
    return g.where("n >= 4")


def _ordered(a, b, c):
    return f"{a} * {b} / (1 - {a}) * {c} / (1 - {a} - {b})"


_TRIO = " + ".join(_ordered(a, b, c) for a, b, c in (("p1", "p2", "p3"), ("p1", "p3", "p2"), ("p2", "p1", "p3"), ("p2", "p3", "p1"), ("p3", "p1", "p2"), ("p3", "p2", "p1")))


@query(sql(f"SELECT contest, round({_ordered('p1', 'p2', 'p3')}, 6) AS p FROM T3", _T3))
def h1_harville_ordered(spark, sf):
    return _triples(spark, sf).select("contest", F.round(P.harville_ordered(F.col("p1"), F.col("p2"), F.col("p3")), 6).alias("p"))


@query(sql(f"SELECT contest, round({_TRIO}, 6) AS skip, round(greatest({_TRIO}, 1e-6), 6) AS clamp FROM T3", _T3))
def h2_harville_trio(spark, sf):
    ps = [F.col(c) for c in ("p1", "p2", "p3")]
    return _triples(spark, sf).select("contest", F.round(P.harville_trio(*ps), 6).alias("skip"), F.round(P.harville_trio(*ps, guard="clamp"), 6).alias("clamp"))


@query(sql("SELECT contest, round(p1 * p2 / (1 - p1) + p2 * p1 / (1 - p2), 6) AS p FROM T3", _T3))
def h3_harville_pair(spark, sf):
    return _triples(spark, sf).select("contest", F.round(P.harville_pair(F.col("p1"), F.col("p2")), 6).alias("p"))


@query(sql(f"SELECT contest, round(0.77 / ({_TRIO}), 4) AS trio, round(0.825 / (p1 * p2 / (1 - p1) + p2 * p1 / (1 - p2)), 4) AS pair FROM T3", _T3))
def h4_synthetic_odds(spark, sf):
    ps = [F.col(c) for c in ("p1", "p2", "p3")]
    return _triples(spark, sf).select("contest", F.round(P.synthetic_odds(P.harville_trio(*ps), P.RAKE_TRIO), 4).alias("trio"), F.round(P.synthetic_odds(P.harville_pair(*ps[:2]), P.RAKE_PAIR), 4).alias("pair"))


@query(sql("SELECT contest, round(p1 * odds, 6) AS ev FROM T3 WHERE p1 * odds >= 1.05 AND p1 >= 0.25", _T3))
def h5_ev_gate(spark, sf):
    return P.ev_gate(_triples(spark, sf).withColumn("ev", F.col("p1") * F.col("odds")), 1.05, 0.25, "ev", "p1").select("contest", F.round("ev", 6).alias("ev"))


_KELLY = "CASE WHEN odds > 1 THEN greatest(0, ((odds - 1) * p1 - (1 - p1)) / (odds - 1) * 0.25) ELSE 0 END"


@query(sql(f"SELECT contest, round({_KELLY}, 6) AS f FROM T3", _T3))
def h6_kelly(spark, sf):
    return _triples(spark, sf).select("contest", F.round(P.kelly(F.col("p1"), F.col("odds"), 0.25), 6).alias("f"))


@query(sql("SELECT contest, greatest(10.0, round_even(payout / 10, 0) * 10) AS ticket FROM T3", _T3))
def h7_round_ticket(spark, sf):
    return _triples(spark, sf).select("contest", P.round_ticket(F.col("payout")).alias("ticket"))


_CAPS = "CP AS (SELECT *, least(p / 10, 0.05, payout * 1000 * 0.02 / 10000) AS own FROM RK WHERE model_rank <= 3)"


@query(sql("SELECT contest, participant, round(greatest(0, least(own, 0.05 - coalesce(sum(own) OVER (PARTITION BY contest ORDER BY model_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))), 6) AS capped FROM CP", _CAPS))
def h8_caps(spark, sf):
    e = ranked(spark, sf).where("model_rank <= 3").withColumns({"fraction": F.col("p") / 10, "pool": F.col("payout") * 1000, "rank": F.col("model_rank")})
    return P.caps(e).select("contest", "participant", F.round("capped", 6).alias("capped"))


@query(sql("SELECT contest, round(CASE WHEN payout >= 45 THEN least(0.01 * payout / 45, 0.035) ELSE 0 END, 6) AS f FROM T3", _T3))
def h9_value_stake(spark, sf):
    return _triples(spark, sf).select("contest", F.round(P.value_stake(F.col("payout")), 6).alias("f"))


@query(sql("SELECT contest, participant, CASE WHEN distance <= 1200 THEN 0.0553 WHEN distance <= 1650 THEN 0.0777 ELSE 0.07 END::DOUBLE AS hit FROM RK WHERE model_rank = 1"))
def h10_regime_prob(spark, sf):
    dim = spark.createDataFrame([("Sprint", 0.0553), ("Mile", 0.0777), ("Stayer", 0.07)], "regime string, hit double")
    e = ranked(spark, sf).where("model_rank = 1").withColumn("regime", distance_regime(F.col("distance")))
    return P.regime_prob(e, dim).select("contest", "participant", "hit")


@query(sql("SELECT b.contest, CAST(w.combo IS NOT NULL AS INTEGER) AS won, round(coalesce(20.0 / 10 * w.dividend, 0), 4) AS returned FROM (SELECT contest, list_sort(list(participant)) AS combo FROM RK WHERE model_rank <= 3 GROUP BY contest HAVING count(*) = 3) b LEFT JOIN (SELECT contest, list_sort(list(participant)) AS combo, max(payout) AS dividend FROM RK WHERE position <= 3 GROUP BY contest HAVING count(*) = 3) w ON w.contest = b.contest AND w.combo = b.combo"))
def h11_settle_actual(spark, sf):
    e = ranked(spark, sf)
    three = lambda df: df.groupBy("contest").agg(F.array_sort(F.collect_list("participant")).alias("combo"), F.max("payout").alias("dividend")).where(F.size("combo") == 3)
    bets = three(e.where("model_rank <= 3")).drop("dividend").withColumn("stake", F.lit(20.0))
    return M.settle_actual(bets, three(e.where("position <= 3"))).select("contest", "won", F.round("returned", 4).alias("returned"))


@query(sql("SELECT contest, CAST(lead = 1 AND legs >= 2 AS INTEGER) AS won, round(CASE WHEN lead = 1 AND legs >= 2 THEN pay ELSE 0 END, 4) AS returned FROM (SELECT contest, max(CAST(position <= 3 AND model_rank = 1 AS INTEGER)) AS lead, sum(CAST(position <= 3 AND model_rank > 1 AS INTEGER)) AS legs, avg(odds) AS pay FROM RK WHERE model_rank <= 5 GROUP BY contest)"))
def h12_settle_synthetic(spark, sf):
    e = ranked(spark, sf).where("model_rank <= 5").withColumns({"anchor": (F.col("model_rank") == 1).cast("int"), "pay": F.col("odds")})
    return M.settle_synthetic(e).select("contest", "won", F.round("returned", 4).alias("returned"))


_CONFIGS = [("quarter", 0.25, 2.0), ("tenth", 0.1, 2.0), ("twentieth", 0.05, 4.0)]
_L1 = """CF AS (SELECT * FROM (VALUES ('quarter', 0.25::DOUBLE, 2.0::DOUBLE), ('tenth', 0.1::DOUBLE, 2.0::DOUBLE), ('twentieth', 0.05::DOUBLE, 4.0::DOUBLE)) t(config, mult, floor)),
CB AS MATERIALIZED (SELECT season, config, fraction, odds, won, row_number() OVER (PARTITION BY season, config ORDER BY d, contest) AS i FROM (SELECT *, CASE WHEN odds > 1 THEN greatest(0, ((odds - 1) * p - (1 - p)) / (odds - 1) * 1.0::DOUBLE) ELSE 0 END * mult AS fraction FROM BT, CF WHERE odds >= floor) WHERE fraction > 0),
LG AS (SELECT season, config, 0::BIGINT AS i, 10000.0::DOUBLE AS bank, 0::BIGINT AS n, 0::BIGINT AS wins, 0.0::DOUBLE AS turnover, 10000.0::DOUBLE AS low FROM (SELECT DISTINCT season, config FROM CB)
 UNION ALL SELECT x.season, x.config, x.i, CASE WHEN made THEN bank - stake + CASE WHEN won = 1 THEN stake * odds ELSE 0 END ELSE bank END AS bank, n + CAST(made AS BIGINT), wins + CAST(made AS BIGINT) * won, turnover + CASE WHEN made THEN stake ELSE 0 END, least(low, CASE WHEN made THEN bank - stake + CASE WHEN won = 1 THEN stake * odds ELSE 0 END ELSE bank END)
 FROM (SELECT *, stake <= bank AS made FROM (SELECT c.season, c.config, c.i, c.odds, c.won, l.bank, l.n, l.wins, l.turnover, l.low, greatest(10.0, round_even(l.bank * c.fraction / 10, 0) * 10) AS stake FROM LG l JOIN CB c ON c.season = l.season AND c.config = l.config AND c.i = l.i + 1)) x)"""


@query(sql("SELECT season, config, round(ln(max_by(bank, i) / 10000), 6) AS growth, max_by(n, i) AS n, max_by(wins, i) AS wins, round(ln(max_by(turnover, i) / 10000), 6) AS turnover, round(max_by(low, i), 2) AS low FROM LG GROUP BY season, config", f"{_BETS}, {_L1}").replace("WITH ", "WITH RECURSIVE ", 1))
def l1_compounding_ledger(spark, sf):
    configs = spark.createDataFrame(_CONFIGS, "config string, mult double, floor double")
    out = M.compounding_ledger(_bets(spark, sf), configs)
    return out.select("season", "config", F.round("growth", 6).alias("growth"), "n", "wins", F.round("log_turnover", 6).alias("turnover"), "low")
