"""Best-fit packing of token documents into sequences of a fixed length, by the sum-of-squares rule.

A document goes into the open bin, or a new one, for which the sum of squares of the numbers of open bins at each
residual gap becomes smallest. Documents longer than a sequence are cut into full pieces and a rest; only those are
cut. Full pieces are sequences by themselves.

Packing is dealt to shards of bounded size, drawn by a hash of the row, so each shard has the same mix of lengths.
Sequences that a shard could not fill are taken apart and packed again, all shards' rests together in fewer shards,
until one is left or nothing is gained.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import settle, ship, text_of, thrifty

SHARD_TOKENS = 1 << 25
SHARD_ROWS = 400_000


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length (longest first, ties in the given order), and what is left free in each bin.

    Moving a bin from gap g to g - s changes the sum of squares by 2 (count[g - s] - count[g]) + 2; opening one by
    2 count[capacity - s] + 1; closing one (gap 0) only takes away. Ties go to the smaller gap.
    """
    order = np.argsort(-lengths, kind="stable")
    count = np.zeros(capacity + 1, np.int64)
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, free = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    for k in order:
        s = int(lengths[k])
        if s == 0:
            where[k] = offset[k] = 0
            continue
        now = count[s:]
        after = count[: capacity + 1 - s].copy()
        after[0] = 0
        change = 2 * (after - now) + 2
        change[0] -= 1  # a closed bin leaves the sum
        change[now == 0] = 1 << 60
        fresh = 2 * count[capacity - s] + 1 if s < capacity else 0
        best = int(np.argmin(change))
        if change[best] <= fresh:
            g = s + best
            b = bins[g].pop()
            count[g] -= 1
        else:
            g, b = capacity, len(free)
            free.append(capacity)
        where[k], offset[k] = b, capacity - g
        free[b] = g - s
        if g > s:
            bins[g - s].append(b)
            count[g - s] += 1
    return where, offset, np.array(free, np.int64)


PIECES = "row_id long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def pieces(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int | None, capacity: int) -> DataFrame:
    """Token pieces of every document, in shared storage: row_id, doc_id, piece, start, length, ids_crc32, ids."""
    ship(spark)
    tail = np.array([] if end_id is None else [end_id], "<u4")

    def cut(batches):
        encoder, task, n = tokens.id_encoder(vocabulary), TaskContext.get().partitionId() << 32, 0
        for b in batches:
            ids, borders = encoder.encode(b.column("text"))
            rows = []
            for k, doc_id in enumerate(b.column("doc_id").to_pylist()):
                own = np.concatenate([ids[borders[k] : borders[k + 1]], tail])
                for p, start in enumerate(range(0, max(1, len(own)), capacity)):
                    data = own[start : start + capacity].astype("<u4").tobytes()
                    rows.append((task + n, doc_id, p, start, len(data) // 4, zlib.crc32(data), data))
                    n += 1
            names = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), names, strict=True)], schema=names)

    return settle(docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(thrifty(cut, ("ids", vocabulary)), PIECES), "pieces")


def _dealt(rows: DataFrame, shards: int, capacity: int, level: int) -> DataFrame:
    """row_id, length, sequence_id, offset, free: each shard of rows packed by itself."""

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row_id"], ascending=[False, True], ignore_index=True)
        where, offset, free = sum_of_squares(pdf["length"].to_numpy(), capacity)
        left = free[where] if len(free) else np.zeros(len(pdf), np.int64)
        return pd.DataFrame({"row_id": pdf["row_id"], "length": pdf["length"], "sequence_id": -1 - ((level << 56) + (int(key[0]) << 32) + where), "offset": offset, "free": left})

    return rows.withColumn("shard", F.pmod(F.xxhash64("row_id"), F.lit(shards))).groupBy("shard").applyInPandas(pack, "row_id long, length long, sequence_id long, offset long, free long")


def assign(rows: DataFrame, capacity: int = 4096, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """sequence_id and offset of every (row_id, length) of a stored table; lengths are at most capacity.

    row_ids are not negative. A full piece's sequence has its row_id, and sequences of shards have negative numbers.
    """
    full = rows.where(F.col("length") == capacity).select("row_id", F.col("row_id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, done, level, before = rows.where(F.col("length") < capacity).select("row_id", "length"), [full], 0, None
    while True:
        n, total = rest.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        shards = max(1, -(-total // shard_tokens), -(-n // SHARD_ROWS))
        packed = settle(_dealt(rest, shards, capacity, level), "packed")
        if shards == 1 or shards == before:
            done.append(packed.select("row_id", "sequence_id", "offset"))
            break
        done.append(packed.where("free = 0").select("row_id", "sequence_id", "offset"))
        rest, level, before = packed.where("free > 0").select("row_id", "length"), level + 1, shards
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def pack(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int | None = 1, capacity: int = 4096) -> DataFrame:
    """Every piece of every document with its place: row_id, doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset.

    Null texts are empty (one piece, the end id alone); null and repeated ids are packed row by row; an empty table
    gives no rows; other columns are ignored.
    """
    cut = pieces(spark, docs, vocabulary, end_id, capacity)
    return cut.join(assign(cut, capacity), "row_id")
