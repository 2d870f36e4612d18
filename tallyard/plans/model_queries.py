"""Queries of the model steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyard.functions.scalars import relevance
from tallyard.operators import history as H
from tallyard.operators import market as M
from tallyard.operators import models as L
from tallyard.operators.boosting import candidate_splits, fit_boosted_ranker
from tallyard.operators.relational import brier, log_loss
from tallyard.operators.strategies import SPECS, run_strategy
from tallyard.plans.analogue import entries, with_entries
from tallyard.plans.market_queries import FORM, ranked, scored, sql
from tallyard.plans.table_queries import folds
from tallyard.registry import query
from tallyard.sources.storage import settle, workspace

FEATURES = ["form", "weight", "odds"]


def _features(spark, sf):
    return H.rolling_mean(entries(spark, sf), "participant", "discount", 5, "form").fillna(0.05, ["form"])


def _train(spark, sf):
    return _features(spark, sf).where("d < DATE '1999-09-01'")


@query()
def m1_fit_ranker_linear(spark, sf):
    return L.importance(spark, L.fit_ranker(_train(spark, sf), FEATURES))


@query()
def m1_fit_ranker_trees(spark, sf):
    model = L.fit_ranker(_train(spark, sf), FEATURES, "trees")
    return model.transform(_features(spark, sf).where("d >= DATE '1999-09-01'")).select("contest", "participant", "score")


@query()
def m1_fit_ranker_boosted(spark, sf):
    """Trees by the pairwise loss on the seasons before the last two, stopped by the NDCG of the last but one; scores of the last."""
    e = settle(_features(spark, sf).select("contest", "d", "participant", "position", *FEATURES), "features")  # cuts, fields and scores read it
    model = fit_boosted_ranker(e.where("d < DATE '2000-09-01'"), FEATURES, relevance(F.col("position")), valid=F.col("d") >= F.lit("1999-09-01").cast("date"), rounds=10, depth=3, rate=0.3)
    return model.transform(e.where("d >= DATE '2000-09-01'")).select("contest", "participant", "score")


_CUTS = {"form": [0.0301, 0.0451, 0.0551, 0.0701], "weight": [10.5, 20.5, 30.5, 40.5], "discount": [0.015, 0.035, 0.055, 0.075]}
_CUT_ROWS = ", ".join(f"('{f}', {c}::DOUBLE)" for f, cs in _CUTS.items() for c in cs)
_GRADS = f"""FE AS (SELECT *, coalesce({FORM}, 0.05) AS form FROM E),
TR AS (SELECT a.contest, a.participant, any_value(a.form) AS form, any_value(a.weight) AS weight, any_value(a.discount) AS discount,
         sum(CASE WHEN a.position < b.position THEN -0.5 WHEN a.position > b.position THEN 0.5 ELSE 0 END)::DOUBLE AS g, sum(CASE WHEN a.position <> b.position THEN 0.25 ELSE 0 END)::DOUBLE AS h
       FROM FE a JOIN FE b ON b.contest = a.contest WHERE a.d < DATE '1999-09-01' GROUP BY a.contest, a.participant),
CU AS (SELECT * FROM (VALUES {_CUT_ROWS}) t(feature, cut)),
SP AS (SELECT feature, cut, sum(CASE WHEN v <= cut THEN g ELSE 0 END) AS gl, sum(CASE WHEN v <= cut THEN h ELSE 0 END) AS hl, sum(g) AS ga, sum(h) AS ha
       FROM (SELECT *, CASE feature WHEN 'form' THEN form WHEN 'weight' THEN weight ELSE discount END AS v FROM TR, CU) GROUP BY feature, cut)"""


@query(with_entries("SELECT feature, cut, round(gl * gl / (hl + 1) + (ga - gl) * (ga - gl) / (ha - hl + 1) - ga * ga / (ha + 1), 5) AS gain, round(-0.1 * gl / (hl + 1), 7) AS \"left\", round(-0.1 * (ga - gl) / (ha - hl + 1), 7) AS \"right\" FROM SP", _GRADS))
def m1_boosted_splits(spark, sf):
    """Every split of a first tree's root, with its gain and the values of both leaves."""
    out = candidate_splits(_train(spark, sf), list(_CUTS), relevance(F.col("position")), list(_CUTS.values()))
    return out.select("feature", "cut", F.round("gain", 5).alias("gain"), F.round("left", 7).alias("left"), F.round("right", 7).alias("right"))


@query()
def m2_fit_platt(spark, sf):
    """Of the probabilities to win and to place: losses by season."""
    e = scored(spark, sf).withColumns({"win": (F.col("position") == 1).cast("int"), "placed": (F.col("position") <= 3).cast("int")})
    e = settle(e.select("season", "d", "score", "win", "placed"), "scored")  # two fits and the losses read it
    early = e.where("d < DATE '1999-09-01'")
    e = L.fit_platt(early, "score", "placed")(L.fit_platt(early, "score", "win")(e), "place")
    losses = [f(F.col(p), F.col(y)).alias(f"{y}_{name}") for p, y in (("p", "win"), ("place", "placed")) for name, f in (("brier", brier), ("log_loss", log_loss))]
    return e.groupBy("season").agg(F.count("*").alias("n"), *losses)


@query()
def m3_fit_isotonic(spark, sf):
    e = scored(spark, sf).withColumn("win", (F.col("position") == 1).cast("int"))
    iso = L.fit_isotonic(e.where("d < DATE '1999-09-01'"), "p", "win")
    return iso(e.where("d >= DATE '1999-09-01'")).select("contest", "participant", "calibrated")


_CELLS = """CL AS (SELECT round(p, 2) AS cell, count(*) AS n, sum(CAST(position = 1 AS INTEGER))::DOUBLE AS wins FROM RK WHERE d < DATE '1999-09-01' GROUP BY 1),
MEANS AS (SELECT a.cell AS lo, b.cell AS hi, sum(c.wins) / sum(c.n) AS mean FROM CL a JOIN CL b ON b.cell >= a.cell JOIN CL c ON c.cell BETWEEN a.cell AND b.cell GROUP BY a.cell, b.cell),
LEAST AS (SELECT c.cell, m.lo, min(m.mean) AS mean FROM CL c JOIN MEANS m ON m.lo <= c.cell AND m.hi >= c.cell GROUP BY c.cell, m.lo)"""


@query(sql("SELECT CL.cell, n, round(fit, 6) AS calibrated FROM CL JOIN (SELECT cell, max(mean) AS fit FROM LEAST GROUP BY cell) f ON f.cell = CL.cell", _CELLS))
def m3_isotonic_cells(spark, sf):
    """The isotonic fit of winning on p in hundredths, at its own cells."""
    e = scored(spark, sf).where("d < DATE '1999-09-01'").withColumns({"cell": F.round("p", 2), "win": (F.col("position") == 1).cast("int")})
    cells = e.groupBy("cell").agg(F.count("*").alias("n"))
    return L.fit_isotonic(e, "cell", "win")(cells).select("cell", "n", F.round("calibrated", 6).alias("calibrated"))


@query()
def m4_fit_meta(spark, sf):
    e = H.pressure(ranked(spark, sf).withColumns({"implied": 1 / F.col("odds"), "win": (F.col("position") == 1).cast("int")}), "discount")
    meta = L.fit_meta(e.where("d < DATE '1999-09-01'"), ["score", "implied", "advantage"], "win")
    return meta(e.where("d >= DATE '1999-09-01'")).select("contest", "participant", "meta_p")


@query()
def m5_importance(spark, sf):
    return L.importance(spark, L.fit_ranker(_train(spark, sf), FEATURES, "trees"))


@query(sql("SELECT feature, round(mean_abs, 6) AS mean_abs, round(100 * mean_abs / sum(mean_abs) OVER (), 4) AS percent, 100 * mean_abs / sum(mean_abs) OVER () >= 2 AS kept FROM (SELECT 'discount' AS feature, avg(abs(10 * (discount - m1))) AS mean_abs FROM MM UNION ALL SELECT 'weight', avg(abs(0.01 * (weight - m2))) FROM MM UNION ALL SELECT 'odds', avg(abs(-0.002 * (odds - m3))) FROM MM)", "MM AS (SELECT *, avg(discount) OVER () AS m1, avg(weight) OVER () AS m2, avg(odds) OVER () AS m3 FROM E)"))
def m6_attribution(spark, sf):
    out = L.attribution(entries(spark, sf), L.LinearRanker(["discount", "weight", "odds"], [10.0, 0.01, -0.002]))
    return out.select("feature", F.round("mean_abs", 6).alias("mean_abs"), F.round("percent", 4).alias("percent"), "kept")


_VARIANTS = """MP AS (SELECT contest, participant, discount, weight, odds, greatest(0, 20 - position)::DOUBLE AS rel FROM E),
VA AS (SELECT * FROM (VALUES ('', 0), ('discount', 0), ('discount', 1), ('weight', 0), ('weight', 1), ('odds', 0), ('odds', 1)) t(feature, again)),
PL AS (SELECT MP.*, feature, again, row_number() OVER (PARTITION BY contest, feature, again ORDER BY participant) AS i,
         row_number() OVER (PARTITION BY contest, feature, again ORDER BY md5('42:' || again || ':' || feature || ':' || contest || ':' || participant)) AS k FROM MP, VA),
SW AS (SELECT a.contest, a.participant, a.feature, a.again, a.rel, CASE WHEN a.feature = 'discount' THEN b.discount ELSE a.discount END * 10 + CASE WHEN a.feature = 'weight' THEN b.weight ELSE a.weight END * 0.01 + CASE WHEN a.feature = 'odds' THEN b.odds ELSE a.odds END * -0.002 AS score
       FROM PL a JOIN PL b ON b.contest = a.contest AND b.feature = a.feature AND b.again = a.again AND b.k = a.i),
OD AS (SELECT *, row_number() OVER (PARTITION BY contest, feature, again ORDER BY round(score, 9) DESC, participant) AS got, row_number() OVER (PARTITION BY contest, feature, again ORDER BY rel DESC, participant) AS best FROM SW),
ND AS (SELECT feature, avg(x) AS m FROM (SELECT feature, again, contest, """ + "sum(CASE WHEN got <= 3 THEN (pow(2.0::DOUBLE, rel) - 1) / log2(got + 1) ELSE 0 END) / nullif(sum(CASE WHEN best <= 3 THEN (pow(2.0::DOUBLE, rel) - 1) / log2(best + 1) ELSE 0 END), 0) AS x FROM OD GROUP BY feature, again, contest) GROUP BY feature)"


class _Rounded(L.LinearRanker):
    """Scores to nine digits, so that ties are ties in any engine."""

    def transform(self, e, name="score"):
        return super().transform(e, name).withColumn(name, F.round(name, 9))


@query(with_entries("SELECT a.feature, round(b.m, 6) AS base, round(a.m, 6) AS permuted FROM ND a JOIN ND b ON b.feature = '' WHERE a.feature <> ''", _VARIANTS))
def m6_permutation(spark, sf):
    """What NDCG at 3 of a fixed score falls to when a feature is dealt anew within each contest."""
    model = _Rounded(["discount", "weight", "odds"], [10.0, 0.01, -0.002])
    out = L.permutation_importance(entries(spark, sf), model, model.features, relevance(F.col("position")), repeats=2)
    return out.select("feature", F.round("base", 6).alias("base"), F.round("permuted", 6).alias("permuted"))


@query()
def m7_walk_forward(spark, sf):
    out = L.walk_forward(_features(spark, sf), folds(spark, lookback=5), FEATURES)
    return out.select("fold", "contest", "participant", "score", "p", "place")


@query()
def m7_walk_forward_desk(spark, sf):
    """The last strategy in walk-forward seasons: fitted on the seasons before, bet on actual payouts, summed up by season."""
    e = H.share(L.walk_forward(_features(spark, sf), folds(spark, lookback=5), FEATURES).withColumn("season", F.col("fold")), F.col("p"), "own").withColumn("p", F.col("own"))
    spec = SPECS["v32"]
    return M.season_summary(run_strategy(e, spec), spec.stake.start)


_DCG = "sum(CASE WHEN {r} <= 3 THEN (pow(2.0::DOUBLE, rel) - 1) / log2({r} + 1) ELSE 0 END)"


@query(sql(f"SELECT contest, round({_DCG.format(r='got')} / nullif({_DCG.format(r='best')}, 0), 6) AS ndcg FROM (SELECT *, row_number() OVER (PARTITION BY contest ORDER BY score DESC, participant) AS got, row_number() OVER (PARTITION BY contest ORDER BY rel DESC, participant) AS best FROM (SELECT *, greatest(0, 15 - position) AS rel FROM RK)) GROUP BY contest"))
def m8_ndcg(spark, sf):
    return L.ndcg(scored(spark, sf), "score", relevance(F.col("position"), 15), 3).select("contest", F.round("ndcg", 6).alias("ndcg"))


@query()
def s12_save_load_model(spark, sf):
    path = workspace(spark, "model")
    L.save_model(L.fit_ranker(_train(spark, sf), FEATURES, "trees").model, path)
    again = L.TreeRanker(FEATURES, L.load_model(path))
    return again.transform(_features(spark, sf)).select("contest", "participant", "score")
