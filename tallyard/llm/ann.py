"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Centroids and codebooks are fitted on at most TRAIN_ROWS vectors, drawn by a hash of their ids; every vector is
indexed. How many lists a query visits is measured on that sample: enough to hold COVERAGE of the true neighbours of
some of its rows. A query visits the lists of its nearest centroids and ranks their rows by asymmetric distances (its
own residual, exact, to the rows' codes). Exact distances in double precision of the best RERANK of each list block
give a bound; the index holds how far each row is from its codes, and every other row that could be within the bound is
compared exactly as well, so that the nearest of a visited list are always found.

Copies of a vector stand in the lists with their k + 1 smallest ids, all that an answer can hold of them. Lists longer
than LIST_ROWS are split into blocks that are searched apart, and so are more than QUERY_ROWS queries of a list: a
block is sent once for so many queries, so what is shuffled grows with the rows and the work, and nothing is capped.
Ties go to the smaller id at every step.

Defined results: null vectors, zero vectors, and those with null or non-finite components take no part, nor do null
ids or vectors of a length other than the most frequent one (of ties, the smaller); rows that repeat an id are
candidates of their own, but not for queries of that id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, ship, thrifty

TRAIN_ROWS = 20_000
LIST_ROWS = 8_192
#: Queries that meet a list block in one task; a block is sent once for so many of them.
QUERY_ROWS = 16_384
QUERY_SLICE = 64
#: Dimensions of a part of the residual: few, so that codes are near enough to their rows to rule most of them out.
PART_DIMS = 2
RERANK = 64
#: Share of the sample's true neighbours whose lists must be among those visited.
COVERAGE = 0.97
COVERAGE_QUERIES = 200


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part, but for those of unusual length."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    e = F.col("embedding")
    return vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & e.isNotNull() & F.forall(e, fine) & F.exists(e, lambda x: x != 0))


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids by Lloyd's rounds; an empty one moves to the row that is farthest from its own."""
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own, far = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        empty = np.flatnonzero(n == 0)
        centres[empty] = x[np.argsort(-far, kind="stable")[: len(empty)]]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, far = np.zeros(len(x), np.int64), np.zeros(len(x), x.dtype)
    squares = (centres**2).sum(1)
    for k in range(0, len(x), 4096):
        part = x[k : k + 4096]
        d = squares - 2 * part @ centres.T
        own[k : k + 4096] = d.argmin(1)
        far[k : k + 4096] = d.min(1) + (part**2).sum(1)
    return own, far


class Quantiser:
    """Coarse centroids, and a codebook of up to 256 entries for each part of the residuals."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        sample = sample.astype(np.float32)
        self.coarse = k_means(sample, min(lists, len(sample)), 10, rng)
        self.dims = sample.shape[1]
        self.cuts = np.array_split(np.arange(self.dims), max(1, self.dims // PART_DIMS))
        left = sample - self.coarse[nearest(sample, self.coarse)[0]]
        self.books = [k_means(left[:, c], min(256, len(left)), 6, rng) for c in self.cuts]

        self.probes = self._enough(sample, rng)

    def _enough(self, sample: np.ndarray, rng: np.random.Generator, k: int = 10) -> int:
        own, _ = nearest(sample, self.coarse)
        squares, ranks = (sample**2).sum(1), []
        for q in rng.permutation(len(sample))[:COVERAGE_QUERIES]:
            d = squares - 2 * sample @ sample[q]
            d[q] = np.inf
            near = np.argpartition(d, min(k, len(d) - 1))[:k]
            order = np.argsort(((self.coarse - sample[q]) ** 2).sum(1), kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            ranks.append(place[own[near]])
        return int(np.quantile(np.concatenate(ranks), COVERAGE, method="higher")) + 1

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and codes of each row."""
        x = x.astype(np.float32)
        own, _ = nearest(x, self.coarse)
        left = x - self.coarse[own]
        return own, np.stack([nearest(left[:, c], b)[0] for c, b in zip(self.cuts, self.books, strict=True)], axis=1).astype(np.uint8)

    def errors(self, x: np.ndarray, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Distance of each row to what its list and codes stand for."""
        left = x - self.coarse[own].astype(np.float64)
        return np.sqrt(sum(((left[:, c] - b[codes[:, k]]) ** 2).sum(1) for k, (c, b) in enumerate(zip(self.cuts, self.books, strict=True))))

    def tables(self, queries: np.ndarray, cell: int) -> Iterator[np.ndarray]:
        """For each part, squared distances of the queries' residuals to its codebook's entries, in double precision as
        bounds rest on them: queries x entries."""
        left = queries - self.coarse[cell].astype(np.float64)
        for c, b in zip(self.cuts, self.books, strict=True):
            yield ((left[:, None, c] - b[None, :, :]) ** 2).sum(2)


def search_block(cell: int, q: pd.DataFrame, rows: pd.DataFrame, model: Quantiser, k: int, rerank: int) -> pd.DataFrame:
    """The k nearest rows of one list block for each query, exactly: the best by codes, then all that may be as near as their k-th."""
    rows = rows.sort_values("vec_id", ignore_index=True)
    ids = rows["vec_id"].to_numpy()
    codes = np.ascontiguousarray(np.frombuffer(b"".join(rows["codes"]), np.uint8).reshape(len(rows), -1).T)
    exact = np.stack([unpacked(v, model.dims) for v in rows["vector"]])
    error = rows["error"].to_numpy()
    query_ids = q["query_id"].to_numpy()
    out: list[tuple[np.ndarray, ...]] = []
    for j in range(0, len(q), QUERY_SLICE):
        own = np.stack([unpacked(v, model.dims) for v in q["vector"].iloc[j : j + QUERY_SLICE]])
        rough = np.zeros((len(own), len(rows)))
        for table, code in zip(model.tables(own, cell), codes, strict=True):
            rough += table[:, code]
        near, others = np.sqrt(rough), ids[None, :] != query_ids[j : j + QUERY_SLICE, None]
        rough[~others] = np.inf
        cut = min(max(rerank, k), len(rows)) - 1
        first = np.zeros(rough.shape, bool)
        np.put_along_axis(first, np.argpartition(rough, cut, axis=1)[:, : cut + 1], True, axis=1)
        asked, at = np.nonzero(first & others)
        score = _distances(own, exact, asked, at)
        kth = np.full(len(own), np.inf)
        begins = np.searchsorted(asked, np.arange(len(own) + 1))
        for n in range(len(own)):
            if begins[n + 1] - begins[n] >= k:
                kth[n] = np.partition(score[begins[n] : begins[n + 1]], k - 1)[k - 1]
        # A row is at least as far as its codes are, less its error; the margin is for rounding, and what can't be told is compared.
        least = near - error - 1e-9 * (near + error + np.sqrt((own**2).sum(1))[:, None])
        more = np.nonzero(others & ~first & ~(least > kth[:, None]))
        asked, at, score = np.concatenate([asked, more[0]]), np.concatenate([at, more[1]]), np.concatenate([score, _distances(own, exact, *more)])
        order = np.lexsort((ids[at], score, asked))
        asked, at, score = asked[order], at[order], score[order]
        top = np.arange(len(asked)) - np.searchsorted(asked, asked) < k
        out.append((query_ids[j + asked[top]], ids[at[top]], score[top]))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))


def _distances(queries: np.ndarray, rows: np.ndarray, asked: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Distance of each pair, some thousands at a time, as all pairs of a block may have to be compared."""
    out = np.zeros(len(at))
    for j in range(0, len(at), 8192):
        out[j : j + 8192] = np.sqrt(((rows[at[j : j + 8192]] - queries[asked[j : j + 8192]]) ** 2).sum(1))
    return out


def unpacked(vector: bytes, dims: int) -> np.ndarray:
    """A vector in double precision, of whichever precision it was stored in."""
    return np.frombuffer(vector, np.float32 if len(vector) == 4 * dims else np.float64).astype(np.float64)


INDEX = "vec_id long, cell int, codes binary, error double, vector binary"


def build_index(spark: SparkSession, vectors: DataFrame, lists: int | None = None, train_rows: int = TRAIN_ROWS) -> tuple[Quantiser, DataFrame] | None:
    """The fitted quantiser, and the index in shared storage: vec_id, cell, codes, error, vector (as precise as it is
    given). None if no row takes part."""
    ship(spark)
    good = usable(vectors)
    sizes = good.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return None
    good = good.where(F.size("embedding") == sizes["size"])
    n = sizes["count"]
    drawn = good
    if n > train_rows:  # those of the lowest hashes, about as many as are wanted, so that no partition sends more than its share
        drawn = good.where(F.xxhash64("vec_id") < int(2**64 * (train_rows / n)) - 2**63)
    sample = drawn.orderBy(F.xxhash64("vec_id"), "vec_id").limit(train_rows).select("embedding").toPandas()["embedding"]
    if not len(sample):  # a few ids that repeat very often can leave none
        sample = good.limit(train_rows).select("embedding").toPandas()["embedding"]
    model = Quantiser(np.stack(sample.to_list()), lists or int(np.clip(np.sqrt(n) / 2, 1, 4096)))
    given = spark.sparkContext.broadcast(model)
    stored = np.float32 if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64

    def index(batches):
        for b in batches:
            if b.num_rows:
                x = np.array(b.column("embedding").to_pylist(), np.float64)
                cell, codes = given.value.encode(x)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(given.value.errors(x, cell, codes), pa.float64()), pa.array([v.tobytes() for v in x.astype(stored)], pa.binary())], ["vec_id", "cell", "codes", "error", "vector"])

    return model, settle(good.mapInArrow(thrifty(index), INDEX), "vector-lists")


def nearest_neighbours(spark: SparkSession, vectors: DataFrame, every: int = 100, k: int = 10, probes: int | None = None, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by every, the k nearest found."""
    built = build_index(spark, vectors)
    schema = "query_id long, rank int, vec_id long, score double"
    if built is None:
        return spark.createDataFrame([], schema)
    model, index = built
    probes = probes or model.probes
    given = spark.sparkContext.broadcast(model)
    # An answer can hold no more of a vector's copies than those of its first k + 1 ids, the query's own among them, and
    # no more than k rows of one id. Both windows share one exchange, and rows are cut before it.
    copies = Window.partitionBy("cell", "vector").orderBy("vec_id")
    rows = index.withColumn("nth_id", F.dense_rank().over(copies)).where(F.col("nth_id") <= k + 1)
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("cell", "vector", "vec_id").orderBy("error"))).where(F.col("nth") <= k)
    rows = settle(rows.drop("nth_id", "nth"), "list-rows")
    # As many rows as there are lists, which the quantiser bounds.
    counts = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    n = np.array([counts.get(c, 0) for c in range(len(model.coarse))])

    def visit(batches):
        coarse = given.value.coarse
        for b in batches:
            out = []
            for query_id, vector in zip(b.column("vec_id").to_pylist(), b.column("vector").to_pylist(), strict=True):
                x = unpacked(vector, given.value.dims).astype(np.float32)
                order = np.argsort(((coarse - x) ** 2).sum(1), kind="stable")
                enough = int(np.searchsorted(np.cumsum(n[order]), k + 1)) + 1  # until there are k besides the query
                out += [(query_id, vector, int(c)) for c in order[: max(probes, enough)]]
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int32())], ["query_id", "vector", "cell"])

    queries = index.where(F.col("vec_id") % every == 0).select("vec_id", "vector").mapInArrow(thrifty(visit), "query_id long, vector binary, cell int")
    # Queries and rows of a list are dealt to blocks of bounded size, and each block of the one meets each of the other.
    visits = {r["cell"]: r["n"] for r in queries.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    sizes = spark.createDataFrame([(c, max(1, -(-int(n[c]) // LIST_ROWS)), max(1, -(-visits.get(c, 0) // QUERY_ROWS))) for c in range(len(n))], "cell int, blocks int, parts int")
    sizes = F.broadcast(sizes)  # a row a list, of which there are 4096 at most
    dealt = lambda key, of: F.pmod(F.xxhash64(key), F.col(of)).cast("int")
    all_of = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    queries = queries.join(sizes, "cell").select("query_id", "vector", "cell", dealt("query_id", "parts").alias("part"), all_of("blocks").alias("block"))
    rows = rows.join(sizes, "cell").select("vec_id", "codes", "error", "vector", "cell", dealt("vec_id", "blocks").alias("block"), all_of("parts").alias("part"))

    def compare(key, q: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(rows):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        return search_block(int(key[0]), q, rows, given.value, k, rerank)

    keys = ["cell", "block", "part"]
    found = queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(compare, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
