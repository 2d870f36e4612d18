"""Invariants of ratings, centrality, features, settlement and ledgers on small contests."""

import datetime as dt
import itertools
import math
import random
from itertools import combinations, permutations

import pytest
from pyspark.sql import functions as F

from tallyard.operators import history as H
from tallyard.operators import ledger as L
from tallyard.operators import market as M
from tallyard.operators import ratings as R
from tallyard.operators import relational as J
from tallyard.operators import strategies as S
from tallyard.sources import storage

E = "contest long, d date, participant long, handler long, price double, weight double, discount double, distance int, season string, position int, odds double, payout double"


def contests(n=40, seed=1):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        d = dt.date(2000, 1, 1) + dt.timedelta(days=20 * c)
        who = r.sample(range(12), 5)
        rows += [(c, d, p, p % 3, float(r.randint(1, 99)), float(r.randint(1, 50)), r.random(), 1000 + c, f"{d.year}", k + 1, 1 + r.random() * 9, 50.0) for k, p in enumerate(who)]
    return rows


@pytest.fixture(scope="module")
def e(spark):
    return spark.createDataFrame(contests(), E).cache()


def test_two_newcomers(spark):
    rows = [r for r in contests(1) if r[9] <= 2]
    h = R.pairwise_elo(spark.createDataFrame(rows, E), F.year("d")).collect()
    assert sorted(round(x["rating_after"], 6) for x in h) == [1484, 1516]


def test_ratings_are_zero_sum_and_without_leaks(spark, e):
    e = e.withColumn("margin", F.col("weight") / 10)
    for f in (R.pairwise_elo, R.margin_elo):
        h = f(e, F.year("d"))
        assert all(abs(x["s"]) < 1e-9 for x in h.groupBy("period").agg(F.sum(F.col("rating_after") - F.col("rating")).alias("s")).collect())
    late = e.withColumn("position", F.when(F.year("d") >= 2001, 6 - F.col("position")).otherwise(F.col("position")))
    a, b = (sorted(map(tuple, R.glicko(x, F.year("d")).where("period <= 2001").select("period", "participant", "rating").collect())) for x in (e, late))
    assert a == b


def test_pagerank_sums_to_one(spark, e):
    snaps = spark.createDataFrame([(dt.date(2001, 1, 1),), (dt.date(2002, 1, 1),)], "as_of date")
    ranks = R.pagerank(R.dominance_edges(e, snaps))
    assert [round(x["s"], 9) for x in ranks.groupBy("as_of").agg(F.sum("rank").alias("s")).collect()] == [1, 1]


def test_a_result_changes_nothing_before_it(spark, e):
    cut = 20
    other = e.withColumn("position", F.when(F.col("contest") >= cut, 6 - F.col("position")).otherwise(F.col("position")))
    a, b = (sorted(map(tuple, R.history_features(x).where(F.col("contest") <= cut).drop("position").collect())) for x in (e, other))
    assert a == b


def test_strict_rate_is_one_per_handler_and_contest(e):
    g = H.handler_rate(e).groupBy("contest", "handler").agg(F.count_distinct("handler_rate").alias("n"))
    assert g.where("n > 1").count() == 0
    assert H.softmax(e, "discount", "p").groupBy("contest").agg(F.sum("p").alias("s")).where("abs(s - 1) > 1e-9").count() == 0


def test_dead_heats_add_up(spark):
    bets = spark.createDataFrame([(1, [1, 2, 3], 20.0), (1, [1, 2, 4], 20.0), (2, [1, 2, 3], 20.0)], "contest long, combo array<int>, stake double")
    pay = spark.createDataFrame([(1, [1, 2, 3], 50.0), (1, [1, 2, 3], 30.0)], "contest long, combo array<int>, dividend double")
    got = sorted((r["contest"], r["won"], r["returned"]) for r in J.settle_bets(bets, pay).collect())
    assert got == [(1, 0, 0.0), (1, 1, 160.0), (2, 0, 0.0)]


def test_ledger_stops_when_broke(spark):
    rows = [(k, dt.date(2000, 1, 1 + k), "s", 0.9, 2.0, 0) for k in range(20)]
    bets = spark.createDataFrame(rows, "contest long, d date, season string, p double, odds double, won int")
    configs = spark.createDataFrame([("all", 1.0, 1.0)], "config string, mult double, floor double")
    r = M.compounding_ledger(bets, configs, start=100.0).first()
    assert 0 <= r["bankroll"] < 10 and r["n"] < 20 and r["wins"] == 0


def test_combos(spark, e):
    x = e.where("contest = 0")
    assert J.combos(x, 3, ["participant"], "position").count() == 10
    assert J.combos(x, 2, ["participant"], "position", ordered=True).count() == 20
    assert J.combos(x.withColumn("a", (F.col("position") == 1).cast("int")), 3, ["participant"], "position", anchor="a").count() == 6
    assert J.pairs(x, ["participant"]).count() == 20


def scored_of(e):
    """Entries with fixed probabilities."""
    e = H.softmax(e.withColumn("score", F.col("discount")), "score", "p")
    return e.withColumns({"place": F.expr("1 / (1 + exp(-score))"), "meta": F.expr("1 / (1 + exp(2 - score))")})


def test_every_strategy_runs(e):
    for name, spec in S.SPECS.items():
        out = S.run_strategy(scored_of(e), spec).collect()
        assert all(r["staked"] > 0 and (r["won"] == 1 or r["returned"] == 0) for r in out), name
    assert S.regime_desk(scored_of(e)).agg(F.sum("rows")).first()[0] == e.count()


def test_no_two_rules_are_alike_but_those_that_are_so_by_training():
    same = {}
    for name, spec in S.SPECS.items():
        same.setdefault(spec, []).append(name)
    assert sorted(x for x in same.values() if len(x) > 1) == [["v14", "v16"], ["v5", "v6"], ["v6_1", "v7_1"]]


def field_of(n, contest=1):
    """A contest of n entries, the model's order 0 to n - 1, against public odds that favour the last of them."""
    r = random.Random(n)
    weight = [math.exp(-k / 9) for k in range(n)]
    p = [w / sum(weight) for w in weight]
    return [(contest, dt.date(2000, 1, 1), k, 0, 1.0, 1.0, 0.1, 1400, "2000", n - k, 2 + (n - k) * r.uniform(0.8, 2.5), 50.0, -float(k), p[k], 0.5, 0.1) for k in range(n)]


SCORED = E + ", score double, p double, place double, meta double"


@pytest.mark.parametrize("n", [6, 7, 12])
def test_sweeps_take_all_triples_of_the_top_seven(spark, n):
    rows = field_of(n)
    scored = spark.createDataFrame(rows, SCORED).repartition(3)
    p, odds = [r[-3] for r in rows], [r[10] for r in rows]
    q = [1 / o / sum(1 / o for o in odds) for o in odds]
    trio = lambda x, c: sum(x[i] * x[j] / (1 - x[i]) * x[k] / (1 - x[i] - x[j]) for i, j, k in permutations(c))

    def made(own):
        out = {}
        for c in combinations(range(min(n, 7)), 3) if n >= 7 else ():
            hit, pay = trio(own, c), 0.77 / trio(q, c)
            edge = ((pay - 1) * hit - (1 - hit)) / (pay - 1) * 0.1 if pay > 1 else 0
            stake = round(100_000 * edge / 10) * 10
            if hit * pay >= 1.05 and stake >= 10:
                out[c] = (edge, stake, pay, all(n - k <= 3 for k in c))
        return out

    top = sum(p[:7])
    every = made([x / top for x in p])
    got = S.run_strategy(scored, S.SPECS["v26"]).collect()
    assert n < 7 or (len(every) > 10 and max(k for c in every for k in c) == 6)
    assert [(b["tickets"], b["staked"], b["returned"]) for b in got] == [(len(every), sum(x[1] for x in every.values()), pytest.approx(sum(s * pay for _, s, pay, won in every.values() if won), abs=0.01))] * bool(every)
    best = max(made(p).values(), default=None)
    for name in ("v28", "v29"):
        got = S.run_strategy(scored, S.SPECS[name]).collect()
        assert [(b["staked"], b["won"]) for b in got] == ([(best[1], int(best[3]))] if best and (name == "v28" or len(got)) else [])


@pytest.mark.parametrize("name", ["v6_1", "v7_1"])
def test_bets_of_a_contest_share_its_cap(spark, name):
    p = [0.3, 0.25, 0.2, 0.15, 0.1]
    odds = [[3.6, 4.5, 90.0, 2.0, 3.0], [30.0, 30.0, 90.0, 2.0, 3.0], [9.0, 1.5, 90.0, 1.6, 3.0], [2.0, 2.1, 2.2, 9.0, 30.0]]
    rows = [(c, dt.date(2000, 1, 1), k, 0, 1.0, 1.0, 0.1, 1400, str(2000 + c), 5 - k, o[k], 50.0, -float(k), p[k], 0.5, p[k]) for c, o in enumerate(odds) for k in range(5)]
    want = {}
    for c, o in enumerate(odds):
        total = 0.0
        for k in range(3):
            f = (p[k] - (1 - p[k]) / (o[k] - 1)) * 0.25
            if sum(x < o[k] for x in o) >= 2 and f > 0:
                total += min(f, 0.05 - total)
        if total:
            want[c] = pytest.approx(total * 10_000, abs=1e-3)
    got = S.run_strategy(spark.createDataFrame(rows, SCORED), S.SPECS[name]).collect()
    assert {r["contest"]: r["staked"] for r in got} == want and len(want) == 3


def slow_ledger(tickets, stake):
    """Contest by contest, with Python's own arithmetic."""
    bank, season, out = stake.start, None, []
    for (s, d, c), group in itertools.groupby(sorted(tickets), key=lambda t: t[:3]):
        bank, season = (stake.start if s != season else bank), s
        staked = returned = 0.0
        for _, _, _, _, n, fraction, odds, won in group:
            each = stake.each(bank, fraction, n) if bank > stake.ruin else 0.0
            staked, returned = staked + each * n, returned + won * each * odds
        if staked:
            bank += returned - staked
            out.append((s, c, round(staked, 6), round(returned, 6), round(bank, 6)))
    return out


@pytest.mark.parametrize("stake", [L.Stake("flat", 5.0), L.Stake("share", start=1000.0), L.Stake("rounded", start=1000.0, minimum=10.0, within=True, cap=90.0), L.Stake("rounded", start=500.0, least=20.0, least_risk=15.0, ruin=300.0)])
def test_bankrolls_carry_over(spark, stake):
    r = random.Random(3)
    rows = [(s, dt.date(2000, 1, 1 + c // 4), c, k, r.choice([1, 6]), round(r.random() / 4, 9), round(r.uniform(1, 9), 6), int(r.random() < 0.3)) for s in ("a", "b") for c in range(60) for k in range(r.randint(1, 3))]
    df = spark.createDataFrame(rows, "season string, d date, contest long, k int, n int, fraction double, odds double, won int").repartition(5)
    steps = L.plain(L.fold(df.withColumn("config", F.lit("")), stake))
    got = sorted((x["season"], x["contest"], x["staked"], x["returned"], x["bank"]) for x in steps.collect())
    want = slow_ledger(rows, stake)
    assert got and [x[:2] for x in got] == [x[:2] for x in want]
    assert all(x[2:] == pytest.approx(y[2:], abs=2e-6) for x, y in zip(got, want, strict=True))
    assert L.fold(df.withColumn("config", F.lit("")).limit(0), stake).count() == 0


@pytest.mark.parametrize("stake", [L.Stake("share", start=1000.0), L.Stake("rounded", start=1000.0, minimum=10.0)])
def test_bankrolls_beyond_doubles(spark, stake):
    """Every ticket wins double its stake, 4,000 times: the bankroll ends at 1.5 ** 4000 times its start."""
    rows = [("a", dt.date(2000, 1, 1) + dt.timedelta(c // 7), c, 1, 1, 0.5, 2.0, 1) for c in range(4000)] + [("b", dt.date(2000, 1, 1), c, 1, 1, 1.0, 2.0, int(c < 3)) for c in range(6)]
    df = spark.createDataFrame(rows, "season string, d date, contest long, k int, n int, fraction double, odds double, won int").withColumn("config", F.lit("x"))
    out = {r["season"]: r for r in L.season_ledger(L.fold(df, stake), stake.start).collect()}
    assert out["a"]["growth"] == pytest.approx(4000 * math.log(1.5), abs=0.05) and out["a"]["roi"] == 1.0 and out["a"]["low"] == 1.0
    assert out["b"]["low"] == 0.0 and out["b"]["growth"] is None or stake.how == "rounded"  # the fourth contest takes all


def test_bankrolls_below_doubles(spark):
    """Every ticket loses half of the bankroll, 4,000 times: no contest is left out when it is below the least double."""
    rows = [("a", dt.date(2000, 1, 1) + dt.timedelta(c // 7), c, 1, 1, 0.5, 2.0, 0) for c in range(4000)]
    df = spark.createDataFrame(rows, "season string, d date, contest long, k int, n int, fraction double, odds double, won int").withColumn("config", F.lit("x"))
    stake = L.Stake("share", start=1000.0)
    (r,) = L.season_ledger(L.fold(df, stake), stake.start).collect()
    assert r["contests"] == 4000 and r["growth"] == pytest.approx(4000 * math.log(0.5), abs=1e-4) and r["low"] == 0.0 and r["roi"] == -1.0


def test_strategies_stay_finite_at_ten_times_the_contests(spark, e):
    """Ten years of the same contests after each other, in one season."""
    many = e.crossJoin(spark.range(10).toDF("again")).withColumns({"contest": F.col("contest") + F.col("again") * 1_000_000, "d": F.expr("d + make_interval(again)"), "season": F.lit("one")}).drop("again")
    for name in ("v6_1", "v17", "v26", "v31"):
        for r in S.strategy_seasons(scored_of(many), S.SPECS[name]).collect():
            assert all(v is None or math.isfinite(v) for v in (r["roi"], r["growth"], r["low"]))


def test_equity_by_days_is_equity_by_bets(spark):
    r = random.Random(4)
    rows = [(s, dt.date(2000, 1, 1 + c // 5), c, float(r.randint(-50, 60))) for s in ("a", "b") for c in range(40)]
    df = spark.createDataFrame(rows, "season string, d date, contest long, pnl double")
    got = {(x["season"], x["contest"]): (x["bankroll"], x["peak"]) for x in H.drawdown(H.equity(df, start=100.0)).collect()}
    for s in ("a", "b"):
        bank, peak = 100.0, float("-inf")
        for c in range(40):
            bank += next(x[3] for x in rows if x[0] == s and x[2] == c)
            peak = max(peak, bank)
            assert got[s, c] == (bank, peak)


def test_missing_positions_count_as_last(spark):
    rows = [(*x[:9], None if x[9] == 2 else x[9], *x[10:]) for x in contests(1) if x[9] <= 3]
    e = spark.createDataFrame(rows, E).withColumn("margin", F.lit(0.0))
    places = {x[2]: x[9] for x in rows}
    after = {places[x["participant"]]: x["rating_after"] for x in R.margin_elo(e, F.year("d")).collect()}
    assert after[1] > after[3] > after[None]
    assert len(R.pairwise_elo(e, F.year("d")).collect()) == 2
    assert {x["participant"] for x in R.glicko(e, F.year("d")).collect()} == set(places)


def test_empty_and_lonely(spark, e):
    none = e.limit(0).withColumn("margin", F.lit(0.0))
    assert R.pairwise_elo(none, F.year("d")).count() == R.glicko(none, F.year("d")).count() == R.margin_elo(none, F.year("d")).count() == 0
    assert R.pagerank(R.dominance_edges(none, R.yearly_snapshots(none))).count() == 0
    alone = e.where("position = 1").withColumn("margin", F.lit(0.0))
    assert {(x["rating_after"], x["rd_after"]) for x in R.glicko(alone, F.year("d")).collect()} == {(1500.0, 350.0)}


def test_periods_one_by_one_equal_slow_fold(spark, e):
    """More periods than states are kept apart for."""
    rating, want = {}, {}
    for c in range(40):
        field = [(x[2], x[9]) for x in contests() if x[0] == c]
        gain = {a: sum(32 * ((pa < pb) - 1 / (1 + 10 ** ((rating.get(b, 1500) - rating.get(a, 1500)) / 400))) / 4 for b, pb in field if b != a) for a, pa in field}
        for a, g in gain.items():
            want[c, a] = rating.get(a, 1500) + g
        rating.update({a: want[c, a] for a in gain})
    got = R.pairwise_elo(e.where("contest < 30"), F.col("contest")).collect()
    assert len(got) == 150 and all(abs(x["rating_after"] - want[x["period"], x["participant"]]) < 1e-6 for x in got)


def test_pagerank_that_does_not_settle_is_even(spark, e):
    edges = R.dominance_edges(e, R.yearly_snapshots(e))
    even = R.pagerank(edges, rounds=1, tolerance=0.0).groupBy("as_of").agg(F.count_distinct("rank").alias("n"), F.sum("rank").alias("s")).collect()
    assert even and all(x["n"] == 1 and abs(x["s"] - 1) < 1e-9 for x in even)
    ranks = {(x["as_of"], x["node"]): x["rank"] for x in R.pagerank(edges, tolerance=1e-12).collect()}
    rows = edges.collect()
    for as_of in {x["as_of"] for x in rows}:
        out = {}
        for x in rows:
            if x["as_of"] == as_of:
                out.setdefault(x["src"], {})[x["dst"]] = x["weight"]
        nodes = sorted(n for d, n in ranks if d == as_of)
        r = dict.fromkeys(nodes, 1 / len(nodes))
        for _ in range(200):
            stuck = sum(r[n] for n in nodes if n not in out)
            new = dict.fromkeys(nodes, 0.15 / len(nodes) + 0.85 * stuck / len(nodes))
            for a, to in out.items():
                for b, w in to.items():
                    new[b] += 0.85 * r[a] * w / sum(to.values())
            r = new
        assert all(abs(ranks[as_of, n] - r[n]) < 1e-9 for n in nodes)


def test_interval_of_means(spark):
    rows = [(k, "a" if k % 2 else "b", float(k % 2 or k % 5 == 0)) for k in range(400)]
    ci = {x["season"]: x for x in M.bootstrap_ci(spark.createDataFrame(rows, "contest long, season string, x double"), "x", F.col("contest"), 400, by="season").collect()}
    assert ci["a"]["low"] == ci["a"]["high"] == 1 and 0.1 < ci["b"]["low"] < 0.2 < ci["b"]["high"] < 0.3 and ci[None]["low"] < 0.6 < ci[None]["high"]


def test_the_shared_folder_must_be_named_on_a_cluster(spark):
    class Context:
        master = "spark://elsewhere:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())


def test_a_ledger_makes_its_steps_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    shape = "season string, config string, d date, contest long, k int, n int, fraction double, odds double, won int"
    t = spark.createDataFrame([("s", "", dt.date(2000, 1, 1), c, 1, 1, 0.1, 3.0, c % 2) for c in range(20)], shape)
    row = L.ledger(L.fold(t.mapInArrow(count, shape), L.Stake("rounded", least=10.0)), 100_000.0).collect()
    assert row[0]["contests"] == 20 and row[0]["hits"] == 10 and seen.value == 20


def test_prices_of_triples_are_spelt_out_once(spark):
    shape = "season string, d date, contest long, participant long, position int, odds double, score double, p double, place double, payout double"
    rows = [("s", dt.date(2000, 1, 1), 1, k, k, 2.0 + k, 9.0 - k, (9 - k) / 36, 0.5, 100.0) for k in range(1, 9)]
    for v in ("v26", "v27", "v28", "v29"):
        plan = S.tickets(spark.createDataFrame(rows, shape), S.SPECS[v])._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("aggregate(") <= 2, v  # of the own probabilities and of the market's
