"""Words of whole texts by the batch, and bounded samples of labelled rows to fit classifiers on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, text_of

SLICE_BYTES = 1_000_000


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts, null as empty, some megabytes at a time; a longer text is a slice by itself."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    first, room = 0, SLICE_BYTES
    for k, n in enumerate(pc.binary_length(texts).to_pylist()):
        if room < n and k > first:
            yield texts.slice(first, k - first)
            first, room = k, SLICE_BYTES
        room -= n
    if first < len(texts):
        yield texts.slice(first)


def split(texts: pa.Array, pattern: str | None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words (large_binary), the number of each occurrence, and the texts' borders in these.

    A word ends at what the pattern matches; without one, at white space, and runs of punctuation are words too.
    """
    if pattern is None:
        texts = pc.replace_substring_regex(texts, r"([^\p{L}\p{N}\s]+)", r" \1 ")
        pattern = r"\s+"
    lists = pc.split_pattern_regex(texts, pattern)
    flat, parent = lists.flatten(), pc.list_parent_indices(lists)
    there = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(there).dictionary_encode()
    parent = parent.filter(there).to_numpy(zero_copy_only=False)
    borders = np.concatenate([[0], np.cumsum(np.bincount(parent, minlength=len(texts)))]).astype(np.int64)
    return coded.dictionary.cast(pa.large_binary()), coded.indices.to_numpy(zero_copy_only=False), borders


def cut_long(distinct: pa.Array, codes: np.ndarray, borders: np.ndarray, most: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """What split gives, with words of over most bytes taken as so many words of up to most bytes."""
    pieces = np.maximum(1, -(-pc.binary_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64) // most))
    if not len(pieces) or pieces.max() == 1:
        return distinct, codes, borders
    cut = pa.array([w[k : k + most] for w in distinct.to_pylist() for k in range(0, max(1, len(w)), most)], pa.large_binary())
    starts, n = np.cumsum(pieces) - pieces, pieces[codes]
    ends = np.cumsum(n)
    return cut, np.repeat(starts[codes] - ends + n, n) + np.arange(ends[-1]), np.concatenate([[0], ends])[borders]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_label: dict[int, int], most_bytes: int) -> list[tuple[str, int]]:
    """(text, label) of up to per_label rows of each label, drawn by a hash of the id from the rows that are not held out.

    Texts over most_bytes are left to others of their class. Ids with labels of both kinds take no part. Of several texts
    under one id the one with the least hash is drawn, so that each run draws the same.
    """
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(label).alias("low"), F.max(label).alias("y")).where("low = y")
    sized = docs.select("doc_id", F.octet_length(text_of(docs)).alias("size")).where((F.col("size") > 0) & (F.col("size") <= most_bytes)).select("doc_id")
    known = known.join(sized, "doc_id", "left_semi").select("doc_id", "y")
    drawn = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label[y])
        drawn = part if drawn is None else drawn.unionByName(part)
    # At most as many ids as per_label allows.
    rows = docs.select("doc_id", text_of(docs).alias("text")).join(F.broadcast(drawn), "doc_id").where((F.octet_length("text") > 0) & (F.octet_length("text") <= most_bytes))
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("mark"), "text"))["text"].alias("text"), F.min("y").alias("y")).collect()
    return [(r["text"], r["y"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]))]
