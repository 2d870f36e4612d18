"""A pairwise boosted ranker: trees on histograms, with early stopping by NDCG.

Entries are kept in blocks of whole contests, a row a block, with relevance, binned features and scores as the bytes of
arrays: a contest's pairs are compared within its block, so gradients and curvatures of the pairwise logistic loss need no
shuffle, and a pass costs what its arithmetic costs. A level of a tree is one groupBy over (node, feature, bin), to which
a task sends one row a cell, and whose result has at most nodes x features x bins rows, whatever the data; the driver
picks splits from it. A tree then moves all scores in one pass, which also gives the next tree's gradients and the
validation's NDCG, written to shared storage.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyard.sources.shipping import ship
from tallyard.sources.storage import settle


@dataclass
class Tree:
    """By node (the root is 1, the children of k are 2k and 2k+1): splits (feature's number, its cut's number, gain) and
    values of leaves."""

    splits: dict[int, tuple[int, int, float]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)


@dataclass
class BoostedRanker:
    """features, the cuts of each, and trees; a score is the sum of the trees' values. A value goes left where it is at
    most the cut, or missing."""

    features: list[str]
    cuts: list[list[float]]
    trees: list[Tree] = field(default_factory=list)
    history: list[float] = field(default_factory=list)

    def transform(self, e: DataFrame, name: str = "score") -> DataFrame:
        at = lambda f, b: F.coalesce(F.col(self.features[f]).cast("double") <= self.cuts[f][b], F.lit(True))
        return e.withColumn(name, reduce(lambda s, t: s + _walk(t, at, 1), self.trees, F.lit(0.0)))

    def importance(self) -> dict[str, float]:
        """Sum of the gains of each feature's splits."""
        out = dict.fromkeys(self.features, 0.0)
        for t in self.trees:
            for f, _, gain in t.splits.values():
                out[self.features[f]] += gain
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        state = {"features": self.features, "cuts": self.cuts, "trees": [{"splits": [[k, *s] for k, s in t.splits.items()], "values": list(t.values.items())} for t in self.trees], "history": self.history}
        spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedRanker:
        state = json.loads(spark.read.text(path).first()[0])
        trees = [Tree({s[0]: tuple(s[1:]) for s in t["splits"]}, dict(map(tuple, t["values"]))) for t in state["trees"]]
        return BoostedRanker(state["features"], state["cuts"], trees, state["history"])


def _walk(tree: Tree, goes_left, k: int) -> Column:
    """The value of the leaf below node k."""
    if k not in tree.splits:
        return F.lit(float(tree.values.get(k, 0.0)))
    f, b, _ = tree.splits[k]
    return F.when(goes_left(f, b), _walk(tree, goes_left, 2 * k)).otherwise(_walk(tree, goes_left, 2 * k + 1))


def _nodes(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """The node that each entry has come to."""
    node = np.ones(len(bins), np.int64)
    for k in sorted(tree.splits):
        f, b, _ = tree.splits[k]
        at = np.flatnonzero(node == k)
        node[at] = 2 * k + (bins[at, f] > b)
    return node


def quantile_cuts(e: DataFrame, features: list[str], bins: int = 32) -> list[list[float]]:
    """Up to bins - 1 cuts of each feature at its approximate quantiles, in one pass."""
    at = [k / bins for k in range(1, bins)]
    row = e.agg(*[F.percentile_approx(F.col(f).cast("double"), at, 10_000).alias(f) for f in features]).first()
    return [sorted(set(row[f] or [])) for f in features]


#: The columns of a block: entries of each contest, then of each entry relevance, bins of all features, and score.
BLOCK = {"size": np.int64, "rel": np.float64, "bins": np.int8, "s": np.float64}


def _blocks(batch: pa.RecordBatch, columns: dict) -> Iterator[dict[str, np.ndarray]]:
    for i in range(batch.num_rows):
        yield {c: np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in columns.items()}


def _bins(block: dict[str, np.ndarray], entries: int) -> np.ndarray:
    return block["bins"].reshape(entries, len(block["bins"]) // max(1, entries))


def fields(e: DataFrame, features: list[str], cuts: list[list[float]], relevance: Column, valid: Column) -> DataFrame:
    """valid, size, rel, bins, s: a row a block of contests, entries of a contest in the order of participant. Entries
    without relevance take no part; a value's bin is the number of cuts below it, and 0 where it is missing."""
    names = [f"f{k}" for k in range(len(features))]

    def block(t: pa.Table, border: np.ndarray) -> pa.RecordBatch:
        """Of t's rows, which begin a contest at border."""
        size = np.diff(np.append(border, t.num_rows))
        bins = np.zeros((t.num_rows, len(names)), np.int8)
        for k, own in enumerate(cuts):
            values = t.column(names[k])
            bins[:, k] = np.where(values.is_null().to_numpy(), 0, np.searchsorted(np.array(own, float), values.to_numpy(), "left"))
        rel, is_valid = t.column("rel").to_numpy(), t.column("valid").to_numpy()[border]
        rows = []
        for kind in (False, True):
            own = np.array([x is not None and bool(x) is kind for x in is_valid.tolist()], bool)
            at = np.repeat(own, size)
            if own.any():
                rows.append((kind, size[own].tobytes(), rel[at].tobytes(), bins[at].tobytes(), np.zeros(int(at.sum())).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary() if k else pa.bool_()) for k in range(5)], ["valid", *BLOCK])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch]).combine_chunks()
            if not t.num_rows:
                continue
            codes = t.column("contest").combine_chunks().dictionary_encode(null_encoding="encode")
            codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy()
            border = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1])
            if border[-1]:
                yield block(t.slice(0, border[-1]), border[:-1])
            rest = t.slice(border[-1])
        if rest is not None:
            yield block(rest, np.array([0]))

    ship(e.sparkSession)
    rows = e.select("contest", "participant", valid.alias("valid"), relevance.cast("double").alias("rel"), *[F.col(f).cast("double").alias(n) for f, n in zip(features, names, strict=True)]).where("rel IS NOT NULL")
    in_order = rows.repartition("contest").sortWithinPartitions("contest", "participant", "rel").drop("participant")
    return in_order.mapInArrow(run, "valid boolean, size binary, rel binary, bins binary, s binary")


#: Pairs that are compared at once.
PAIRS = 1_000_000


def _pairwise(first: np.ndarray, size: np.ndarray, rel: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of each entry; a contest's entries lie at first, size of them."""
    g, h = np.zeros(len(s)), np.zeros(len(s))
    rel = np.where(np.isnan(rel), np.inf, rel)
    for m in np.unique(size):
        own = first[size == m]
        at, start = (own[:, None] + np.arange(m)).ravel(), np.repeat(own, m)
        step = max(1, PAIRS // int(m))
        for k in range(0, len(at), step):
            i, j = at[k : k + step], start[k : k + step, None] + np.arange(m)
            better = (rel[i, None] > rel[j]).astype(float) - (rel[i, None] < rel[j])
            with np.errstate(over="ignore"):
                wrong = 1 / (1 + np.exp(better * (s[i, None] - s[j])))
            g[i], h[i] = (-better * wrong).sum(axis=1), (np.abs(better) * wrong * (1 - wrong)).sum(axis=1)
    return g, h


def _ndcg(first: np.ndarray, size: np.ndarray, rel: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """NDCG at k of each contest, NaN where nothing has relevance; ties in the order of entries."""
    out = np.full(len(first), np.nan)
    for m in np.unique(size):
        own = np.flatnonzero(size == m)
        at = first[own][:, None] + np.arange(m)
        top = min(k, int(m))
        gain = lambda key: ((2.0 ** np.take_along_axis(rel[at], np.argsort(-key[at], axis=1, kind="stable")[:, :top], axis=1) - 1) / np.log2(np.arange(top) + 2)).sum(axis=1)  # noqa: B023, E731
        got, best = gain(s), gain(rel)
        out[own] = np.divide(got, best, out=np.full(len(own), np.nan), where=best != 0)
    return out


def with_gradients(contests: DataFrame, tree: Tree | None = None, k: int = 3) -> DataFrame:
    """contests with the tree's values added to their scores, and the gradient and curvature of the loss for each entry:
    over all pairs of the field with different relevance, -ln of the logistic function of the better one's lead. Those
    for validation get no gradients but, in a block, the sum of their NDCG at k and how many have one."""
    values = np.zeros(max([1, *(tree.values if tree else ())]) + 1)
    for node, v in (tree.values if tree else {}).items():
        values[node] = v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, valid in zip(_blocks(batch, BLOCK), batch.column("valid").to_pylist(), strict=True):
                size, rel, s = x["size"], x["rel"], x["s"]
                if tree is not None:
                    s = s + values[_nodes(tree, _bins(x, len(s)))]
                first = np.cumsum(size) - size
                if valid:
                    ndcg = _ndcg(first, size, rel, s, k)
                    out.append((s.tobytes(), b"", b"", float(np.nansum(ndcg)), int((~np.isnan(ndcg)).sum())))
                else:
                    out.append((s.tobytes(), *(v.tobytes() for v in _pairwise(first, size, rel, s)), 0.0, 0))
            kinds = (pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("valid", "size", "rel", "bins")], *[pa.array([o[j] for o in out], t) for j, t in enumerate(kinds)]], ["valid", *BLOCK, "g", "h", "ndcg", "ranked"])

    ship(contests.sparkSession)
    return contests.select("valid", *BLOCK).mapInArrow(run, "valid boolean, size binary, rel binary, bins binary, s binary, g binary, h binary, ndcg double, ranked long")


def histogram(contests: DataFrame, tree: Tree, level: int, use: list[int], width: int) -> DataFrame:
    """node, f, bin, g, h, n: sums over the training entries at the nodes of a level; bins are below width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, cells = 2**level, 2**level * width
        sums = np.zeros((len(use), 3, cells))
        for batch in batches:
            for x in _blocks(batch, {"bins": np.int8, "g": np.float64, "h": np.float64}):
                bins = _bins(x, len(x["g"]))
                node = _nodes(tree, bins)
                at = node >= least
                node, bins, g, h = (node[at] - least) * width, bins[at], x["g"][at], x["h"][at]
                for k, f in enumerate(use):
                    cell = node + bins[:, f]
                    for j, w in enumerate((g, h, None)):
                        sums[k, j] += np.bincount(cell, w, cells)
        k, cell = np.nonzero(sums[:, 2])
        columns = [(least + cell // width).astype(np.int32), np.array(use, np.int32)[k], (cell % width).astype(np.int32), sums[k, 0, cell], sums[k, 1, cell], sums[k, 2, cell].astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "f", "bin", "g", "h", "n"])

    ship(contests.sparkSession)
    each = contests.where("NOT valid").select("bins", "g", "h").mapInArrow(run, "node int, f int, bin int, g double, h double, n long")
    return each.groupBy("node", "f", "bin").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])


def _width(cuts: list[list[float]]) -> int:
    return max([len(c) for c in cuts], default=0) + 1


def best_splits(rows: list, features: int, cuts: list[list[float]], l2: float, least: float) -> dict[int, dict]:
    """Per node: totals, and all its candidate splits as (gain, f, b, left g, left h), the best first. Gains are rounded,
    so that ties go to the first feature and cut whatever the order of the sums."""
    out: dict[int, dict] = {}
    grids: dict[int, np.ndarray] = {}
    width = _width(cuts)
    for r in rows:
        grids.setdefault(r["node"], np.zeros((features, width, 2)))[r["f"], r["bin"]] += (r["g"], r["h"])
    for node, grid in grids.items():
        used = int(np.argmax(grid[:, :, 1].sum(axis=1) > 0))
        G, H = grid[used].sum(axis=0)
        score = lambda g, h: g * g / (h + l2) if h + l2 > 0 else 0.0
        found = []
        for f in range(features):
            left = np.cumsum(grid[f], axis=0)
            for b in range(len(cuts[f])):
                gl, hl = left[b]
                if hl >= least and H - hl >= least and grid[f, :, 1].sum() > 0:
                    found.append((round(score(gl, hl) + score(G - gl, H - hl) - score(G, H), 9), f, b, gl, hl))
        out[node] = {"g": G, "h": H, "found": sorted(found, key=lambda x: (-x[0], x[1], x[2]))}
    return out


def fit_boosted_ranker(
    train: DataFrame, features: list[str], relevance: Column, valid: Column | None = None, rounds: int = 30, depth: int = 4, rate: float = 0.1, bins: int = 32, l2: float = 1.0, least: float = 1.0,
    share: float = 1.0, patience: int = 5, k: int = 3, cuts: list[list[float]] | None = None, seed: int = 42,
) -> BoostedRanker:
    """Trees fitted on the contests where valid is false. With valid, fitting stops when the NDCG at k of the others has
    not risen for `patience` trees, and the trees up to the best stay.

    share: of the features that a tree may use, drawn by a hash of the seed; at least one. Contests of one entry, or of
    equal relevance, have no pairs and change nothing; without any pair there are no trees.
    """
    cuts = cuts if cuts is not None else quantile_cuts(train.where(~valid) if valid is not None else train, features, bins)
    contests = settle(with_gradients(fields(train, features, cuts, relevance, valid if valid is not None else F.lit(False)), k=k), "boost")
    model, best = BoostedRanker(features, cuts), (-1.0, 0)
    for t in range(rounds):
        drawn = sorted(range(len(features)), key=lambda f: crc32(f"{seed}:{t}:{features[f]}".encode()))[: max(1, round(share * len(features)))]
        tree, splits = Tree(), {}
        for level in range(depth):
            splits = best_splits(histogram(contests, tree, level, drawn, _width(cuts)).collect(), len(features), cuts, l2, least)  # nodes x features x bins rows
            before = len(tree.splits)
            for node, s in splits.items():
                tree.values[node] = float(-rate * s["g"] / (s["h"] + l2)) if s["h"] + l2 > 0 else 0.0
                if s["found"] and s["found"][0][0] > 0:
                    gain, f, b, gl, hl = s["found"][0]
                    tree.splits[node] = (f, b, float(gain))
                    for child, g, h in ((2 * node, gl, hl), (2 * node + 1, s["g"] - gl, s["h"] - hl)):
                        tree.values[child] = float(-rate * g / (h + l2))
            if len(tree.splits) == before:
                break
        if not tree.splits:
            break
        tree.values = {n: v for n, v in tree.values.items() if n not in tree.splits}
        model.trees.append(tree)
        if valid is None and t == rounds - 1:
            break
        contests = settle(with_gradients(contests, tree, k), "boost")
        if valid is not None:
            now = contests.where("valid").agg(F.try_divide(F.sum("ndcg"), F.sum("ranked"))).first()[0]
            if now is not None:
                model.history.append(now)
                best = max(best, (round(now, 9), -len(model.trees)))
                if len(model.trees) + best[1] >= patience:
                    break
    if valid is not None and best[1]:
        del model.trees[-best[1] :]
    return model


def candidate_splits(train: DataFrame, features: list[str], relevance: Column, cuts: list[list[float]], l2: float = 1.0, rate: float = 0.1) -> DataFrame:
    """feature, cut, gain, left, right: every split of a first tree's root, with the values of its two leaves."""
    contests = with_gradients(fields(train, features, cuts, relevance, F.lit(False)))
    s = best_splits(histogram(contests, Tree(), 0, list(range(len(features))), _width(cuts)).collect(), len(features), cuts, l2, 0.0).get(1, {"g": 0.0, "h": 0.0, "found": []})
    rows = [(features[f], float(cuts[f][b]), float(gain), float(-rate * gl / (hl + l2)) + 0.0, float(-rate * (s["g"] - gl) / (s["h"] - hl + l2)) + 0.0) for gain, f, b, gl, hl in s["found"]]
    return train.sparkSession.createDataFrame(rows, "feature string, cut double, gain double, left double, right double")
