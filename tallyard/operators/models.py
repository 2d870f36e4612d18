"""Model steps: pairwise rankers, calibrators, importance, attribution, walk-forward evaluation.

Logistic models of many groups (folds, targets) are fitted together: a Newton step of all of them is one groupBy. An
isotonic fit pools violators by ranges, and then across them, so that blocks and not rows meet.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyard.functions.scalars import relevance
from tallyard.operators import history as H
from tallyard.operators.boosting import BoostedRanker, fit_boosted_ranker
from tallyard.operators.relational import pairs
from tallyard.sources.shipping import ship
from tallyard.sources.storage import settle


class LinearRanker:
    """Weights of a linear score, learnt from pairs of one contest."""

    def __init__(self, features: list[str], weights: list[float]):
        self.features, self.weights = features, weights

    def transform(self, e: DataFrame, name: str = "score") -> DataFrame:
        return e.withColumn(name, sum((F.coalesce(F.col(f), F.lit(0.0)) * w for f, w in zip(self.features, self.weights, strict=True)), F.lit(0.0)))


class TreeRanker:
    def __init__(self, features: list[str], model: PipelineModel):
        self.features, self.model = features, model

    def transform(self, e: DataFrame, name: str = "score") -> DataFrame:
        out = self.model.transform(e.fillna(0.0, self.features))
        return out.withColumnRenamed("prediction", name).drop("_x")


#: Rows of a partition that trees are fitted on.
TREE_ROWS = 200_000


def _tree_rows(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """features without nulls and label, dealt evenly: a task of the trees' many passes reads at most about TREE_ROWS
    rows, however many there are, and what made them runs once. Trees hang on the rows' order by their sample of
    candidate splits alone."""
    rows = settle(df.select(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features], F.col(label).cast("double").alias(label)), "trees")
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-rows.count() // TREE_ROWS)))


def fit_ranker(train: DataFrame, features: list[str], kind: str = "linear"):
    """linear: logistic regression without intercept on differences within a contest. boosted: trees boosted by the
    pairwise loss, see `boosting`. trees: Spark's boosted trees on relevance, entry by entry."""
    if kind == "boosted":
        return fit_boosted_ranker(train, features, relevance(F.col("position")), rounds=10, depth=3, rate=0.3)
    if kind == "trees":
        from pyspark.ml import Pipeline

        data = _tree_rows(train.withColumn("label", relevance(F.col("position"))), features, "label")
        return TreeRanker(features, Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), GBTRegressor(featuresCol="_x", labelCol="label", maxIter=10, maxDepth=4, seed=42)]).fit(data))
    both = pairs(train.fillna(0.0, features), ["participant", "position", *features], ordered=False)
    x = F.array(*[F.col(f"{f}_a") - F.col(f"{f}_b") for f in features])
    data = both.select(array_to_vector(x).alias("features"), (F.col("position_a") < F.col("position_b")).cast("double").alias("label"))
    model = LogisticRegression(fitIntercept=False, maxIter=20, regParam=1e-6).fit(data)
    return LinearRanker(features, [float(w) for w in model.coefficients])


def fit_platt(df: DataFrame, score: str, target: str):
    """Logistic regression on one score, with an L2 term of 1 over the number of rows. Returns df -> df with p."""
    data = settle(df.select(F.col(score).cast("double").alias("x"), F.col(target).cast("double").alias("label")), "platt")  # counted, then fitted
    data = data.select(array_to_vector(F.array("x")).alias("features"), "label")
    model = LogisticRegression(regParam=1.0 / max(1, data.count()), standardization=False, maxIter=50).fit(data)
    w, b = float(model.coefficients[0]), float(model.intercept)
    return lambda e, name="p": e.withColumn(name, 1 / (1 + F.exp(-(F.col(score) * w + b))))


def pooled_blocks(lo: np.ndarray, hi: np.ndarray, y: np.ndarray, n: np.ndarray) -> list[tuple]:
    """Neighbouring blocks pooled until their means rise; blocks are (lo, hi, sum of the target, rows), in order."""
    out: list[list] = []
    for block in zip(lo.tolist(), hi.tolist(), y.tolist(), n.tolist(), strict=True):
        out.append(list(block))
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            _, h, s, m = out.pop()
            out[-1][1:] = [h, out[-1][2] + s, out[-1][3] + m]
    return [tuple(b) for b in out]


#: Blocks of an isotonic fit that the driver holds; beyond so many, ranges are pooled again.
BLOCKS = 50_000


def isotonic_blocks(df: DataFrame, p: str, target: str, most: int = BLOCKS) -> list[tuple]:
    """The blocks of the isotonic fit. Rows of equal p meet before the shuffle; ranges of p are pooled where they lie, and
    their blocks in ever fewer ranges. Should more than `most` blocks remain, as only as many different rates can make
    them, neighbouring ones are taken together in equal steps of p."""
    ship(df.sparkSession)
    kind = "lo double, hi double, y double, n long"

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            new = [b.column(k).to_pylist() for k in range(4)]
            held = pooled_blocks(*[np.array([*[h[k] for h in held], *new[k]]) for k in range(4)])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True) if held else [[]] * 4, [pa.float64()] * 3 + [pa.int64()], strict=True)], ["lo", "hi", "y", "n"])

    rows = df.select(F.col(p).cast("double").alias("lo"), F.col(target).cast("double").alias("y")).where("lo IS NOT NULL AND y IS NOT NULL")
    rows = rows.groupBy("lo").agg(F.sum("y").alias("y"), F.count("*").alias("n")).select("lo", F.col("lo").alias("hi"), "y", "n")
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        rows = settle(rows.repartitionByRange(ranges, "lo").sortWithinPartitions("lo").mapInArrow(pool, kind), "blocks")
        n, last, ranges = rows.count(), ranges == 1, max(1, ranges // 16)
        if n <= most:
            break
        if last:
            ends = rows.agg(F.min("lo"), F.max("lo")).first()
            cell = F.width_bucket("lo", F.lit(ends[0]), F.lit(ends[1]), F.lit(max(1, most - 2)))
            rows = rows.groupBy(cell).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("y").alias("y"), F.sum("n").alias("n"))
            break
    found = sorted(tuple(r) for r in rows.select("lo", "hi", "y", "n").collect())  # up to `most` blocks
    return pooled_blocks(*[np.array(c) for c in zip(*found, strict=True)]) if found else []


def fit_isotonic(df: DataFrame, p: str, target: str):
    """Isotonic calibration: between two blocks values rise in a line, and they are clipped at the ends. Returns df -> df."""
    blocks = isotonic_blocks(df, p, target)
    x = np.array([v for b in blocks for v in b[:2]]) if blocks else np.zeros(1)
    y = np.repeat([b[2] / b[3] for b in blocks], 2) if blocks else np.zeros(1)

    @F.pandas_udf("double")
    def at(c: pd.Series) -> pd.Series:
        return pd.Series(np.interp(c, x, y)).where(c.notna().to_numpy())

    return lambda e, name="calibrated": e.withColumn(name, at(F.col(p).cast("double")))


def fit_meta(df: DataFrame, features: list[str], target: str):
    """Boosted trees on score, market and field; returns df -> df with meta_p."""
    vector = VectorAssembler(inputCols=features, outputCol="_x")
    model = GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=8, maxDepth=3, seed=42).fit(vector.transform(_tree_rows(df.withColumn("_y", F.col(target)), features, "_y")))

    def use(e: DataFrame, name: str = "meta_p") -> DataFrame:
        out = model.transform(vector.transform(e.fillna(0.0, features)))
        return out.withColumn(name, vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")

    return use


def importance(spark, model) -> DataFrame:
    """feature, weight: weights by size, or the trees' importances."""
    if isinstance(model, BoostedRanker):
        rows = list(model.importance().items())
    elif isinstance(model, LinearRanker):
        rows = list(zip(model.features, model.weights, strict=True))
    else:
        rows = list(zip(model.features, [float(v) for v in model.model.stages[-1].featureImportances.toArray()], strict=True))
    return spark.createDataFrame(rows, "feature string, weight double").orderBy(F.desc(F.abs("weight")), "feature")


def attribution(df: DataFrame, model: LinearRanker, prune: float = 2.0) -> DataFrame:
    """feature, mean_abs, percent, kept: mean distance of w x from its own mean, exact for a linear score."""
    means = df.agg(*[F.avg(f).alias(f"_m_{f}") for f in model.features])
    near = df.crossJoin(F.broadcast(means))  # one row
    parts = near.agg(*[F.avg(F.abs(w * (F.col(f) - F.col(f"_m_{f}")))).alias(f) for f, w in zip(model.features, model.weights, strict=True)])
    rows = parts.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("mean_abs")) for f in model.features])).alias("x")).select("x.*")
    percent = 100 * F.col("mean_abs") / F.sum("mean_abs").over(Window.partitionBy(F.lit(1)))  # one row a feature
    return rows.withColumn("percent", percent).withColumn("kept", F.col("percent") >= prune)


def permutation_importance(e: DataFrame, model, features: list[str], rel: Column, k: int = 3, repeats: int = 3, seed: int = 42) -> DataFrame:
    """feature, base, permuted, drop: mean NDCG at k of the model's order, and what it is when a feature's values are dealt
    anew within each contest, by a hash of seed, repeat, feature, contest and participant. All features and repeats are
    scored in one pass; model is anything with transform(df, name)."""
    rows = e.select("contest", "participant", rel.cast("double").alias("rel"), *features)
    one = rows.groupBy("contest").agg(F.sort_array(F.collect_list(F.struct("participant", "rel", *features))).alias("field"))
    variants = F.array(F.struct(F.lit("").alias("feature"), F.lit(0).alias("again")), *[F.struct(F.lit(f).alias("feature"), F.lit(r).alias("again")) for f in features for r in range(repeats)])
    each = one.select("contest", "field", F.explode(variants).alias("v"))
    digest = lambda a: F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("v.again"), F.col("v.feature"), F.col("contest"), a["participant"]).cast("binary"))
    dealt = F.when(F.col("v.feature") != "", F.array_sort(F.transform("field", lambda a, i: F.struct(digest(a).alias("h"), i.alias("i")))))
    each = each.withColumn("dealt", dealt)
    other = lambda i, f: F.get("field", F.get("dealt", i)["i"])[f]
    cell = lambda a, i, f: F.when(F.col("v.feature") == f, other(i, f)).otherwise(a[f]).alias(f)
    moved = F.transform("field", lambda a, i: F.struct(a["participant"].alias("participant"), a["rel"].alias("rel"), *[cell(a, i, f) for f in features]))
    flat = each.select("contest", "v.feature", "v.again", F.explode(moved).alias("x")).select("contest", F.col("feature").alias("_feature"), F.col("again").alias("_again"), "x.*")
    # The variants of a contest lie where the contest does, so that nothing is shuffled again.
    scores = ndcg(model.transform(flat, "score"), "score", F.col("rel"), k, ["contest", "_feature", "_again"]).groupBy(F.col("_feature").alias("feature")).agg(F.avg("ndcg").alias("permuted"))
    base = scores.where("feature = ''").select(F.col("permuted").alias("base"))
    out = scores.where("feature <> ''").crossJoin(F.broadcast(base))  # one row
    return out.select("feature", "base", "permuted", (F.col("base") - F.col("permuted")).alias("drop"))


def fit_logistics(rows: DataFrame, by: str, x: list[str], label: str, penalty, steps: int = 25, tolerance: float = 1e-8) -> dict[str, np.ndarray]:
    """Weights of a logistic model for each value of by, all fitted together by Newton steps.

    A step is one groupBy: losses, gradients and curvatures are summed by group, and the driver solves a small system for
    each. A step that raises a group's loss is halved. penalty: (number of rows) -> the weights' L2 terms, an array. Groups
    are few and known by what the rows hold.
    """
    spark, d = rows.sparkSession, len(x)
    groups = [r[0] for r in rows.select(by).distinct().collect()]  # few: folds and targets
    at = {g: np.zeros(d) for g in groups}
    good: dict[str, tuple[np.ndarray, float]] = {}
    live = set(groups)
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    for _ in range(steps):
        if not live:
            break
        given = spark.createDataFrame([(g, *map(float, at[g])) for g in sorted(live)], ", ".join([f"{by} string", *[f"w{i} double" for i in range(d)]]))
        z = sum((F.col(c) * F.col(f"w{i}") for i, c in enumerate(x)), F.lit(0.0))
        r = rows.join(F.broadcast(given), by).withColumn("z", z)  # a row a group
        r = r.withColumn("q", 1 / (1 + F.exp(-F.col("z"))))
        loss = F.log1p(F.exp(-F.abs("z"))) + F.greatest(F.col("z"), F.lit(0.0)) - F.col(label) * F.col("z")
        sums = [F.sum((F.col("q") - F.col(label)) * F.col(c)).alias(f"g{i}") for i, c in enumerate(x)] + [F.sum(F.col("q") * (1 - F.col("q")) * F.col(x[i]) * F.col(x[j])).alias(f"h{i}_{j}") for i, j in upper]
        for s in r.groupBy(by).agg(F.count("*").alias("n"), F.sum(loss).alias("loss"), *sums).collect():
            g, w, c = s[by], at[s[by]], penalty(s["n"])
            total = s["loss"] + 0.5 * float((c * w * w).sum())
            if g in good and total > good[g][1] + 1e-9 * abs(good[g][1]):
                at[g] = (good[g][0] + w) / 2
                continue
            grad = np.array([s[f"g{i}"] for i in range(d)]) + c * w
            curve = np.zeros((d, d))
            for i, j in upper:
                curve[i, j] = curve[j, i] = s[f"h{i}_{j}"]
            step = np.linalg.lstsq(curve + np.diag(c + 1e-9), grad, rcond=None)[0]
            good[g], at[g] = (w, total), w - step
            if np.abs(step).max() <= tolerance * (1 + np.abs(w).max()):
                live.discard(g)
    return at


def walk_forward(e: DataFrame, folds: DataFrame, features: list[str], kind: str = "linear") -> DataFrame:
    """Test entries of every fold, scored by a ranker fitted on its train window, with probabilities to win and to place
    from the last train year that the ranker did not see. Folds without test entries, or with too little to fit on, give
    no rows. Linear rankers and all calibrators are fitted together, in as many jobs for many folds as for one; other
    rankers one fold after the other."""
    e = settle(e, "features")
    f = folds.select(F.col("fold").cast("string").alias("fold"), "train_start", F.add_months("train_end", -12).alias("cut"), "train_end", "test_start", "test_end")
    if kind != "linear":
        return _one_by_one(e, f, features, kind)
    f = F.broadcast(f)  # a row a fold
    both = pairs(e.fillna(0.0, features), ["participant", "position", "d", *features], ordered=False)
    both = both.select(F.col("d_a").alias("d"), (F.col("position_a") < F.col("position_b")).cast("double").alias("y"), *[(F.col(f"{c}_a") - F.col(f"{c}_b")).alias(c) for c in features])
    both = settle(both, "pairs").join(f, F.col("d").between(F.col("train_start"), F.col("cut")))
    weights = fit_logistics(both, "fold", features, "y", lambda n: np.full(len(features), 1e-6 * n))
    if not weights:
        return e.withColumns({"score": F.lit(0.0), "p": F.lit(0.0), "place": F.lit(0.0), "fold": F.lit("")}).limit(0)
    spark = e.sparkSession
    known = F.broadcast(spark.createDataFrame([(g, [float(v) for v in w]) for g, w in weights.items()], "fold string, _w array<double>"))  # a row a fold
    score = sum((F.coalesce(F.col(c), F.lit(0.0)) * F.col("_w")[i] for i, c in enumerate(features)), F.lit(0.0))
    scored = lambda window: e.join(f, window).join(known, "fold").withColumn("score", score)
    late = scored((F.col("d") > F.col("cut")) & (F.col("d") <= F.col("train_end")))
    target = lambda name, y: F.struct(F.lit(name).alias("t"), y.cast("double").alias("y"))
    late = late.select("fold", "score", F.explode(F.array(target("p", F.col("position") == 1), target("place", F.col("position") <= 3))).alias("x"))
    late = late.select(F.concat_ws("|", "fold", "x.t").alias("model"), "score", F.lit(1.0).alias("one"), "x.y").where("y IS NOT NULL")
    curves = fit_logistics(late, "model", ["score", "one"], "y", lambda n: np.array([1.0, 0.0]))
    ready = [(g, *[float(v) for t in ("p", "place") for v in curves[f"{g}|{t}"]]) for g in weights if f"{g}|p" in curves and f"{g}|place" in curves]
    curve = F.broadcast(spark.createDataFrame(ready, "fold string, _p0 double, _p1 double, _q0 double, _q1 double"))  # a row a fold
    out = scored(F.col("d").between(F.col("test_start"), F.col("test_end"))).join(curve, "fold")
    at = lambda a, b: 1 / (1 + F.exp(-(F.col("score") * F.col(a) + F.col(b))))
    added = ["score", "p", "place", "fold"]
    return out.withColumns({"p": at("_p0", "_p1"), "place": at("_q0", "_q1")}).select(*[c for c in e.columns if c not in added], *added)


def _one_by_one(e: DataFrame, folds: DataFrame, features: list[str], kind: str) -> DataFrame:
    out = e.withColumns({"score": F.lit(0.0), "p": F.lit(0.0), "place": F.lit(0.0), "fold": F.lit("")}).limit(0)
    for f in folds.orderBy("test_start").collect():  # a row a fold
        train = e.where(F.col("d").between(f["train_start"], f["train_end"]))
        early, late = train.where(F.col("d") <= F.lit(f["cut"])), train.where(F.col("d") > F.lit(f["cut"]))
        if not early.head(1) or not late.head(1):
            continue
        model = fit_ranker(early, features, kind)
        held = model.transform(late).withColumns({"win": F.col("position") == 1, "placed": F.col("position") <= 3})
        win, place = fit_platt(held, "score", "win"), fit_platt(held, "score", "placed")
        test = model.transform(e.where(F.col("d").between(f["test_start"], f["test_end"])))
        out = out.unionByName(place(win(test), "place").withColumn("fold", F.lit(f["fold"])))
    return out


def ndcg(e: DataFrame, score: str, rel: Column, k: int = 3, keys: Sequence[str] = ("contest",)) -> DataFrame:
    """keys, ndcg: discounted gain of the first k by score over that of the best order."""
    e = e.withColumn("_rel", rel)
    by = lambda c: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(c), "participant"))
    e = e.withColumns({"_got": by(score), "_best": by("_rel")})
    gain = lambda r: F.sum(F.when(F.col(r) <= k, (F.pow(F.lit(2.0), F.col("_rel")) - 1) / F.log2(F.col(r) + 1)).otherwise(0.0))
    return e.groupBy(*keys).agg(F.try_divide(gain("_got"), gain("_best")).alias("ndcg"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
