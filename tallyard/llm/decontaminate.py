"""Benchmark decontamination with a distributed positional inverted index.

The index is kept in shards of documents: a row holds, for up to BLOCK_WORDS words of some documents, each term with
the ascending list of its positions. Benchmark items become windows of consecutive words. A window's terms are looked
up from the one that is rarest over the whole index to the most frequent: each list, moved by the term's offset in the
window, is intersected with what is left, and most windows end after one or two lists. Phrases are such intersections
at offsets that match exactly; proximity matches allow each term a distance around its place.

Defined results: null and empty texts have no words, hits or items and are clean; items without words match nothing;
items that share an item_id count once, and null item_ids hit words but are not listed; rows that repeat a doc_id, or
have none, are judged row by row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, settle, ship, text_of, thrifty

BLOCK_WORDS = 500_000
BLOCK_ROWS = 50_000
#: Places left free between documents: more than a window and the distance allowed to its terms, so none reaches over.
GAP = 64
ITEM_BYTES = 4 << 20
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
INDEX = "block long, doc_ids array<long>, text_keys array<long>, n_words array<long>, terms array<binary>, ends binary, positions binary"


def words_of(text: str | None) -> list[bytes]:
    """ASCII letters and digits in lower case, and all beyond ASCII; anything else ends a word."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _invert(folded: list[bytes]) -> tuple[list[int], pa.Array, bytes, bytes]:
    """Words in each text, the terms, the ends of their lists, and the lists."""
    lists = pc.split_pattern(pa.array(folded, pa.large_binary()), pattern=b" ")
    flat, parent = lists.flatten(), pc.list_parent_indices(lists)
    there = pc.greater(pc.binary_length(flat), 0)
    flat, parent = flat.filter(there), parent.filter(there).to_numpy(zero_copy_only=False)
    sizes = np.bincount(parent, minlength=len(folded)).astype(np.int64)
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    places = (np.arange(len(codes)) + parent * GAP).astype("<u4")[order]
    ends = np.cumsum(np.bincount(codes, minlength=len(coded.dictionary))).astype("<u4")
    return sizes.tolist(), coded.dictionary.cast(pa.binary()), ends.tobytes(), places.tobytes()


def build_index(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The index of docs, in shared storage: blocks of about BLOCK_WORDS words or BLOCK_ROWS rows, whichever is less.
    Documents are known by doc_id and, as ids may repeat, a hash of their text."""
    ship(spark)
    longs = pa.list_(pa.int64())
    names = pa.schema([("block", pa.int64()), ("doc_ids", longs), ("text_keys", longs), ("n_words", longs), ("terms", pa.list_(pa.binary())), ("ends", pa.binary()), ("positions", pa.binary())])

    def index(batches):
        task, n = TaskContext.get().partitionId() << 32, 0
        ids, keys, folded, room = [], [], [], BLOCK_WORDS * 6

        def close():
            sizes, terms, ends, places = _invert(folded)
            listed = pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), terms)
            return pa.RecordBatch.from_arrays([pa.array([task + n]), *(pa.array([x], longs) for x in (ids, keys, sizes)), listed, pa.array([ends], pa.binary()), pa.array([places], pa.binary())], schema=names)

        for b in batches:
            for doc_id, key, text in zip(b.column("doc_id").to_pylist(), b.column("text_key").to_pylist(), b.column("text"), strict=True):
                data = text.as_buffer()
                ids.append(doc_id)
                keys.append(key)
                folded.append(data.to_pybytes().translate(_FOLD) if data else b"")
                room -= len(folded[-1])
                if room < 0 or len(ids) >= BLOCK_ROWS:
                    yield close()
                    ids, keys, folded, room, n = [], [], [], BLOCK_WORDS * 6, n + 1
        if ids:
            yield close()

    rows = docs.select("doc_id", F.xxhash64(text_of(docs)).alias("text_key"), text_of(docs).alias("text"))
    return settle(rows.mapInArrow(thrifty(index), INDEX), "postings")


def item_windows(items: list[tuple], window: int) -> dict:
    """The different windows of the items, in arrays: vocabulary (sorted), terms (windows by window, numbers in the
    vocabulary, its length where a window is shorter), length, and the items of each: ids from borders[k] on are owners."""
    texts = pa.array([words_of(t) for _, t in items], pa.list_(pa.large_binary()))
    coded = texts.flatten().dictionary_encode()
    order = np.array(pc.sort_indices(coded.dictionary))
    number = np.zeros(len(order), np.int32)
    number[order] = np.arange(len(order))
    codes = number[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int32)
    borders = texts.offsets.to_numpy()
    rows, owners = [], []
    for k, (a, b) in enumerate(zip(borders, borders[1:], strict=False)):
        if b - a >= window:
            rows.append(np.lib.stride_tricks.sliding_window_view(codes[a:b], window))
        elif b > a:
            rows.append(np.concatenate([codes[a:b], np.full(window - (b - a), len(order), np.int32)])[None, :])
        owners.append(np.full(len(rows[-1]) if b > a else 0, k))
    if not rows:
        return {"terms": np.zeros((0, window), np.int32)}
    every, owner = np.concatenate(rows), np.concatenate(owners)
    by = np.lexsort(every.T[::-1])
    every, owner = every[by], owner[by]
    new = np.concatenate([[True], (every[1:] != every[:-1]).any(axis=1)])
    pairs = np.unique(np.stack([np.cumsum(new) - 1, owner], axis=1), axis=0)
    terms = every[new]
    names = np.array([None if i is None else str(i) for i, _ in items], object)
    return {"vocabulary": coded.dictionary.take(pa.array(order)), "terms": terms, "length": (terms < len(order)).sum(1), "items": names[pairs[:, 1]], "borders": np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1))}


def _row(b: pa.RecordBatch, name: str, k: int) -> pa.Array:
    """A row's list, not copied."""
    column = b.column(name)
    return column.values.slice(column.offsets[k].as_py(), column.offsets[k + 1].as_py() - column.offsets[k].as_py())


def _numbers(b: pa.RecordBatch, name: str, k: int) -> np.ndarray:
    return np.frombuffer(b.column(name)[k].as_buffer(), "<u4").astype(np.int64)


def _among(sought: np.ndarray, there: np.ndarray, near: int) -> np.ndarray:
    """Which of the sought positions are in the ascending list there, or at most near away from one that is."""
    at = np.searchsorted(there, sought - near)
    return (at < len(there)) & (there[np.minimum(at, len(there) - 1)] <= sought + near)


def match_block(known: np.ndarray, starts: np.ndarray, positions: np.ndarray, query: dict, near: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every occurrence in one block of the index: the window's number, its first position, and that of its rarest
    term. known has the number in the query's vocabulary of each of the block's terms, or -1."""
    size = len(query["vocabulary"])
    local = np.full(size + 1, -1, np.int64)
    local[known[known >= 0]] = np.flatnonzero(known >= 0)
    wanted = query["matrix"]  # terms of each window from the rarest on, the last column's number where there are fewer
    live = np.arange(len(wanted))
    for c in range(wanted.shape[1]):
        live = live[(local[wanted[live, c]] >= 0) | (wanted[live, c] == size)]
    which, where, rarest = [], [], []
    for w in live:
        n = query["length"][w]
        rows, offsets = local[wanted[w, :n]], query["offsets"][w, :n].astype(np.int64)
        base = positions[starts[rows[0]] : starts[rows[0] + 1]] - offsets[0]
        for r, o in zip(rows[1:], offsets[1:], strict=True):
            if not base.size:
                break
            base = base[_among(base + o, positions[starts[r] : starts[r + 1]], near)]
        if base.size:
            which.append(np.full(base.size, w))
            where.append(base)
            rarest.append(base + offsets[0])
    if not which:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(which), np.concatenate(where), np.concatenate(rarest)


def _query(spark: SparkSession, index: DataFrame, items: list[tuple], window: int) -> dict | None:
    """Windows of a bounded block of items, each with its terms in the order of their counts in the whole index."""
    query = item_windows(items, window)
    if not len(query["terms"]):
        return None
    size = len(query["vocabulary"])
    given = spark.sparkContext.broadcast(query["vocabulary"])

    def count(batches):
        for b in batches:
            sums = np.zeros(size, np.int64)
            for k in range(b.num_rows):
                known = _known(b, k, given.value)
                there = known >= 0
                sums[known[there]] += np.diff(_numbers(b, "ends", k), prepend=0)[there]
            there = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(sums[there])], ["term", "n"])

    counted = index.select("terms", "ends").mapInArrow(thrifty(count), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    total = np.full(size + 1, np.iinfo(np.int64).max)
    total[:size] = 0
    for r in counted.toLocalIterator():  # as many rows as the block of items has terms
        total[r["term"]] = r["n"]
    given.destroy()
    order = np.argsort(total[query["terms"]], axis=1, kind="stable")
    return query | {"matrix": np.take_along_axis(query.pop("terms"), order, axis=1), "offsets": order.astype(np.int16)}


def _known(b: pa.RecordBatch, k: int, vocabulary: pa.Array) -> np.ndarray:
    """Number in the vocabulary of each term of a row, or -1."""
    return pc.fill_null(pc.index_in(_row(b, "terms", k).cast(vocabulary.type), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)


HITS = "block long, ordinal int, spans array<struct<a:long,b:long>>, items array<string>"


def matches(spark: SparkSession, index: DataFrame, benchmark: DataFrame, window: int = 13, near: int = 0) -> DataFrame:
    """block, ordinal, spans (words hit, from a up to b), items (their ids as strings) of every document with an occurrence.

    Items are taken in blocks of about ITEM_BYTES, dealt by a hash: a query block is what the driver and the tasks
    hold at a time, however many items there are, and each is run against the whole index.
    """
    ship(spark)
    if window + near >= GAP:
        raise ValueError(f"window and near reach {GAP} words or more")
    # Rows that repeat an item count once; left in, they would all be dealt to one block, however large.
    texts = settle(benchmark.select("item_id", text_of(benchmark).alias("text")).dropDuplicates(), "items")
    blocks = 1 + int(texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]) // ITEM_BYTES
    found = None
    for k in range(blocks):
        mine = [(r["item_id"], r["text"]) for r in texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toLocalIterator()]
        query = _query(spark, index, mine, window)
        if query is None:
            continue
        given = spark.sparkContext.broadcast(query)

        def look(batches, given=given):
            query = given.value
            for b in batches:
                for k in range(b.num_rows):
                    starts, positions = np.concatenate([[0], _numbers(b, "ends", k)]), _numbers(b, "positions", k)
                    got = match_block(_known(b, k, query["vocabulary"]), starts, positions, query, near)
                    if len(got[0]):
                        found = _by_document(b.column("block")[k].as_py(), _row(b, "n_words", k).to_numpy(), *got, query, near)
                        yield pa.RecordBatch.from_pandas(found, schema=_HITS, preserve_index=False)

        part = settle(index.select("block", "n_words", "terms", "ends", "positions").mapInArrow(thrifty(look), HITS), "hits")
        given.destroy()  # its hits are stored: nothing asks for it again
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], HITS)


_HITS = pa.schema([("block", pa.int64()), ("ordinal", pa.int32()), ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("items", pa.list_(pa.string()))])


def _by_document(block: int, sizes: np.ndarray, which: np.ndarray, where: np.ndarray, rarest: np.ndarray, query: dict, near: int) -> pd.DataFrame:
    first = np.cumsum(sizes + GAP) - sizes - GAP
    doc = np.searchsorted(first, rarest, side="right") - 1  # of documents at one place, all but the last are empty
    where = np.maximum(where, first[doc])
    order = np.lexsort((where, doc))
    which, where, doc = which[order], where[order], doc[order]
    out = []
    for part in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(doc)) + 1):
        d = int(doc[part[0]])
        spans: list[list[int]] = []
        for a, n in zip((where[part] - first[d]).tolist(), query["length"][which[part]].tolist(), strict=True):
            b = min(a + n + near, int(sizes[d]))
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
        items = {i for w in set(which[part].tolist()) for i in query["items"][query["borders"][w] : query["borders"][w + 1]]}
        out.append((block, d, [{"a": a, "b": b} for a, b in spans], sorted(items - {None})))
    return pd.DataFrame(out, columns=["block", "ordinal", "spans", "items"])


def judge(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = 13, near: int = 0, share: int = 20) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_words, n_hit, n_items, items, contaminated (a hit, and at least one word
    in share hit) of every row. item_ids are of any type that survives a cast to string and back; doc_ids are longs."""
    index = build_index(spark, docs)
    each = F.posexplode(F.arrays_zip("doc_ids", "text_keys", "n_words")).alias("ordinal", "x")
    rows = index.select("block", each).select("block", "ordinal", F.col("x.doc_ids").alias("doc_id"), F.col("x.text_keys").alias("text_key"), F.col("x.n_words").alias("n_words"))
    kind = benchmark.schema["item_id"].dataType.simpleString()
    # Spans of several query blocks may overlap: sorted, each adds what reaches beyond those before it.
    found = matches(spark, index, benchmark, window, near).groupBy("block", "ordinal").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).cast(f"array<{kind}>").alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    add = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["end"]))).alias("n"), F.greatest(s["end"], x["b"]).alias("end"))
    found = found.select("block", "ordinal", F.aggregate("spans", start, add)["n"].alias("n_hit"), F.array_sort("items").alias("items"))
    out = rows.join(found, ["block", "ordinal"], "left").select("doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast(f"array<{kind}>")).alias("items"))
    return out.withColumns({"n_items": F.size("items").cast("long"), "contaminated": (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))})


def without_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """Rows of docs, all columns, that the benchmark does not contaminate."""
    key, bad_id, bad_key = free_names(["text_key", "bad_id", "bad_key"], docs.columns)
    bad = judge(spark, docs, benchmark, window, share=share).where("contaminated").select(F.col("doc_id").alias(bad_id), F.col("text_key").alias(bad_key)).distinct()
    return docs.withColumn(key, F.xxhash64(text_of(docs))).join(bad, F.col("doc_id").eqNullSafe(F.col(bad_id)) & (F.col(key) == F.col(bad_key)), "left_anti").drop(key)
