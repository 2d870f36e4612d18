"""Model steps against slow versions, and what they are for: order, calibration, effects that are known."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyard.operators import boosting as B
from tallyard.operators import models as L

E = "contest long, participant long, d date, position int, a double, b double"


def made(n=120, seed=1, start=dt.date(2000, 1, 1)):
    """Contests in which values of a near 0.5 win, which no linear score of a can tell; b says nothing."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        field = [(p, rng.random(), rng.random()) for p in range(rng.randrange(2, 7))]
        order = sorted(field, key=lambda x: abs(x[1] - 0.5) + rng.gauss(0, 0.03))
        rows += [(c, p, start + dt.timedelta(days=7 * c), k, a if p else None, b) for k, (p, a, b) in enumerate(order, 1)]
    return rows


def slow_boost(rows, cuts, rounds, depth, rate, l2=1.0, least=1.0):
    """Scores by (contest, participant), with loops."""
    data = [(c, p, 20.0 - pos, [0 if v is None else sum(v > x for x in own) for v, own in zip((a, b), cuts)]) for c, p, _, pos, a, b in rows]
    s = np.zeros(len(data))
    for _ in range(rounds):
        g, h = np.zeros(len(data)), np.zeros(len(data))
        for i, x in enumerate(data):
            for j, y in enumerate(data):
                if x[0] == y[0] and x[2] > y[2]:
                    q = 1 / (1 + np.exp(s[i] - s[j]))
                    g[i] -= q
                    g[j] += q
                    h[i] += q * (1 - q)
                    h[j] += q * (1 - q)

        def grow(at, level):
            G, H = g[at].sum(), h[at].sum()
            best = (0.0, None)
            for f, own in enumerate(cuts):
                for b in range(len(own)):
                    left = [i for i in at if data[i][3][f] <= b]
                    gl, hl = g[left].sum(), h[left].sum()
                    gain = round(gl**2 / (hl + l2) + (G - gl) ** 2 / (H - hl + l2) - G**2 / (H + l2), 9)
                    if min(hl, H - hl) >= least and gain > best[0]:
                        best = (gain, (f, b))
            if level == depth or best[1] is None:
                s[at] += -rate * G / (H + l2)
                return
            f, b = best[1]
            grow([i for i in at if data[i][3][f] <= b], level + 1)
            grow([i for i in at if data[i][3][f] > b], level + 1)

        grow(list(range(len(data))), 0)
    return {(x[0], x[1]): v for x, v in zip(data, s, strict=True)}


def rel():
    return F.greatest(F.lit(0), 20 - F.col("position"))


def test_boosted_scores_are_those_of_loops(spark):
    rows, cuts = made(40), [[0.2, 0.4, 0.6, 0.8], [0.5]]
    e = spark.createDataFrame(rows, E)
    model = B.fit_boosted_ranker(e, ["a", "b"], rel(), rounds=3, depth=2, rate=0.3, cuts=cuts)
    want = slow_boost(rows, cuts, 3, 2, 0.3)
    got = {(r["contest"], r["participant"]): r["score"] for r in model.transform(e).collect()}
    assert len(model.trees) == 3 and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_contests_are_kept_in_blocks_and_lie_across_batches(spark):
    rows, cuts = made(60), [[0.2, 0.4, 0.6, 0.8], [0.5]]
    e = spark.createDataFrame(rows, E)
    blocks = B.fields(e, ["a", "b"], cuts, rel(), F.lit(False))
    assert 0 < blocks.count() <= 8  # two a partition
    want = slow_boost(rows, cuts, 2, 2, 0.3)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        model = B.fit_boosted_ranker(e.withColumn("contest", F.concat(F.lit("c"), "contest")), ["a", "b"], rel(), rounds=2, depth=2, rate=0.3, cuts=cuts)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    got = {(r["contest"], r["participant"]): r["score"] for r in model.transform(e).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_boosted_beats_linear_stops_early_and_comes_back(spark, tmp_path):
    e = spark.createDataFrame(made(150, 2), E).cache()
    late = F.col("contest") >= 100
    model = B.fit_boosted_ranker(e, ["a", "b"], rel(), valid=late, rounds=12, depth=2, rate=0.4, bins=12, patience=2)
    linear = L.fit_ranker(e.where(~late), ["a", "b"])
    mean = lambda m: L.ndcg(m.transform(e.where(late)), "score", rel(), 3).agg(F.avg("ndcg")).first()[0]
    assert mean(model) > mean(linear) + 0.1
    assert mean(model) == pytest.approx(max(model.history)) and len(model.trees) == int(np.argmax(np.round(model.history, 9))) + 1
    weights = {r["feature"]: r["weight"] for r in L.importance(spark, model).collect()}
    assert weights["a"] > 5 * weights["b"]
    model.save(spark, f"file://{tmp_path}/m")
    again = B.BoostedRanker.load(spark, f"file://{tmp_path}/m")
    assert again == model
    # A permuted feature costs order only where the model rests on it.
    drop = {r["feature"]: r["drop"] for r in L.permutation_importance(e.where(late), model, ["a", "b"], rel(), repeats=2).collect()}
    assert drop["a"] > 0.1 and abs(drop["b"]) < 0.05


def test_nothing_to_rank(spark):
    e = spark.createDataFrame([(1, 1, None, 1, 0.5, 0.5), (2, 1, None, None, 0.5, None)], E)
    model = B.fit_boosted_ranker(e, ["a", "b"], rel(), rounds=2)
    assert model.trees == [] and [r["score"] for r in model.transform(e).collect()] == [0.0, 0.0]
    assert B.fit_boosted_ranker(e.limit(0), ["a"], rel(), rounds=2).trees == []
    assert L.fit_logistics(e.limit(0).withColumn("g", F.lit("x")), "g", ["a"], "b", lambda n: np.zeros(1)) == {}


def slow_logistic(x, y, c):
    w = np.zeros(x.shape[1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) + np.diag(c), x.T @ (q - y) + c * w)
    return w


def test_logistics_of_many_groups_are_those_of_each(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g, slope in (("u", 2.0), ("v", -0.5), ("w", 0.0)):
        x = rng.normal(size=200)
        rows += [(g, float(v), 1.0, float(rng.random() < 1 / (1 + np.exp(-slope * v - 0.3)))) for v in x]
    df = spark.createDataFrame(rows, "g string, x double, one double, y double").repartition(5)
    jobs = lambda f: (spark.sparkContext.setJobGroup(f"t{id(f)}", ""), f(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"t{id(f)}")))[1:]
    got, many = jobs(lambda: L.fit_logistics(df, "g", ["x", "one"], "y", lambda n: np.array([1.0, 0.0])))
    _, one = jobs(lambda: L.fit_logistics(df.where("g = 'u'"), "g", ["x", "one"], "y", lambda n: np.array([1.0, 0.0])))
    for g in "uvw":
        own = np.array([r[1:] for r in rows if r[0] == g])
        assert got[g] == pytest.approx(slow_logistic(own[:, :2], own[:, 2], np.array([1.0, 1e-9])), abs=1e-6)
    assert many <= one + 6
    platt = L.fit_platt(df.where("g = 'u'"), "x", "y")(df.where("g = 'u'"))
    w = got["u"]
    assert all(r["p"] == pytest.approx(1 / (1 + np.exp(-(w[0] * r["x"] + w[1]))), abs=2e-3) for r in platt.collect())


def test_folds_together_are_folds_one_by_one(spark):
    e = spark.createDataFrame(made(250, 5, dt.date(1996, 3, 1)), E)
    day = lambda y: dt.date(y, 1, 1)
    folds = [(str(y), day(y - 2), day(y) - dt.timedelta(1), day(y), day(y + 1) - dt.timedelta(1)) for y in (1998, 1999, 2000)] + [("1980", day(1978), day(1979), day(1980), day(1981))]
    schema = "fold string, train_start date, train_end date, test_start date, test_end date"
    key = lambda r: (r["fold"], r["contest"], r["participant"])
    every = {key(r): r for r in L.walk_forward(e, spark.createDataFrame(folds, schema), ["a", "b"]).collect()}
    single = {key(r): r for f in folds[:2] for r in L.walk_forward(e, spark.createDataFrame([f], schema), ["a", "b"]).collect()}
    assert {k[0] for k in every} == {"1998", "1999", "2000"} and single.keys() == {k for k in every if k[0] != "2000"}
    for k, r in single.items():
        assert every[k]["score"] == pytest.approx(r["score"], abs=1e-7) and every[k]["p"] == pytest.approx(r["p"], abs=1e-7) and every[k]["place"] == pytest.approx(r["place"], abs=1e-7)
    assert L.walk_forward(e, spark.createDataFrame(folds[3:], schema), ["a", "b"]).count() == 0


def test_isotonic_is_the_best_rising_fit(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(round(rng.random(), 2), 0.0) for _ in range(600)]
    rows = [(p, float(rng.random() < p * p)) for p, _ in rows]
    df = spark.createDataFrame(rows, "p double, y double")
    xs = sorted({p for p, _ in rows})
    mean = {x: (sum(y for p, y in rows if p == x), sum(p == x for p, _ in rows)) for x in xs}
    avg = lambda i, j: sum(mean[x][0] for x in xs[i : j + 1]) / sum(mean[x][1] for x in xs[i : j + 1])
    want = {x: max(min(avg(i, j) for j in range(k, len(xs))) for i in range(k + 1)) for k, x in enumerate(xs)}
    got = L.fit_isotonic(df, "p", "y")(spark.createDataFrame([(x,) for x in [*xs, -1.0, 2.0, None]], "p double")).collect()
    assert all(r["calibrated"] == pytest.approx(want[r["p"]]) for r in got if r["p"] in want)
    assert [r["calibrated"] for r in got if r["p"] in (-1.0, 2.0)] == pytest.approx([want[xs[0]], want[xs[-1]]]) and got[-1]["calibrated"] is None
    assert len(L.isotonic_blocks(df, "p", "y", most=5)) <= 5
    assert L.fit_isotonic(df.limit(0), "p", "y")(df).agg(F.max("calibrated")).first()[0] == 0.0


def test_meta_and_saved_trees(spark, tmp_path):
    e = spark.createDataFrame(made(60, 7), E).withColumn("win", (F.col("position") == 1).cast("int")).withColumn("near", F.abs(F.coalesce("a", F.lit(0.0)) - 0.5))
    out = L.fit_meta(e, ["near", "b"], "win")(e).select("meta_p", "win").collect()
    rate = sum(r["win"] for r in out) / len(out)
    brier = lambda p: sum((p(r) - r["win"]) ** 2 for r in out)
    assert all(0 <= r["meta_p"] <= 1 for r in out) and brier(lambda r: r["meta_p"]) < 0.7 * brier(lambda r: rate)
    model = L.fit_ranker(e, ["near", "b"], "trees")
    L.save_model(model.model, f"file://{tmp_path}/t")
    again = L.TreeRanker(model.features, L.load_model(f"file://{tmp_path}/t"))
    scores = lambda m: sorted((r["contest"], r["participant"], r["score"]) for r in m.transform(e).collect())
    assert scores(model) == scores(again)


def test_platt_makes_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(k / 50 - 1, int(k % 3 > 0)) for k in range(100)], "score double, y int").repartition(2)
    L.fit_platt(df.mapInArrow(count, df.schema), "score", "y")
    assert seen.value == 100


def test_tree_rows_are_bounded_by_task(spark, monkeypatch):
    monkeypatch.setattr(L, "TREE_ROWS", 100)
    df = spark.range(5000).selectExpr("CAST(id AS DOUBLE) AS a", "id % 2 AS y", "CAST(NULL AS DOUBLE) AS b")
    rows = L._tree_rows(df, ["a", "b"], "y")
    sizes = rows.rdd.mapPartitions(lambda r: [sum(1 for _ in r)]).collect()
    assert sum(sizes) == 5000 and max(sizes) <= 110 and rows.where("b <> 0").count() == 0
