"""Token ids in sorted-string-table shards.

A shard holds documents in the order of their keys. Layout: blocks, block index, Bloom filter, footer.

    block   entries, compressed with zstd; an entry is: bytes shared with the key before (varint), bytes that follow
            (varint), those bytes, ids before it in the shard (varint), number of ids (varint), ids (uint32, little-endian)
    index   one record a block: first key (length as varint, bytes), offset, length, CRC-32 (uint64, uint32, uint32)
    Bloom   bits; a key sets BLOOM_HASHES of them
    footer  offset and length of the index, offset and length of the filter, entries, ids, blocks, magic

A key is one byte, 0 for a null id and 1 for any other, and the id as big-endian uint64 with the sign bit turned, so
bytes sort as ids do. An id that repeats has as many entries, one behind the other.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import fresh, open_fs, settle, ship, text_of, thrifty, write_file

BLOCK_BYTES = 256 << 10
#: A task takes about so many bytes of text, and begins a new shard when one holds so many bytes of ids and keys.
RANGE_BYTES = 64 << 20
SHARD_BYTES = 64 << 20
ENTRY_BYTES = 32
BLOOM_BITS = 10
BLOOM_HASHES = 7
MAGIC = b"TYSST001"
_FOOTER = struct.Struct("<QQQQQQQ8s")
_PLACE = struct.Struct("<QII")


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" * 9 if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def bloom_bits(key: bytes, size: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & ((1 << 64) - 1), (h >> 64) | 1
    return [(a + k * b) % size for k in range(BLOOM_HASHES)]


def shard_bytes(entries: Iterator[tuple[int | None, bytes]], summary: dict) -> Iterator[bytes]:
    """The bytes of one shard from (id, ids) in key order; summary is filled as they go out. Memory: one block, and
    a key and an index record for each entry and block."""
    squeeze = zstandard.ZstdCompressor(level=1)
    index, keys, at, ids = [], [], 0, 0
    block, first, last = bytearray(), b"", b""

    def close() -> bytes:
        nonlocal block, at
        data = squeeze.compress(bytes(block))
        index.append((first, at, len(data), zlib.crc32(data)))
        at += len(data)
        block = bytearray()
        return data

    for doc_id, value in entries:
        key = key_of(doc_id)
        if not block:
            first, last = key, b""
        shared = next((k for k, (x, y) in enumerate(zip(key, last, strict=False)) if x != y), min(len(key), len(last)))
        n = len(value) // 4
        block += varint(shared) + varint(len(key) - shared) + key[shared:] + varint(ids) + varint(n) + value
        last = key
        keys.append(key)
        ids += n
        if len(block) >= BLOCK_BYTES:
            yield close()
    if block:
        yield close()
    records = b"".join(varint(len(k)) + k + _PLACE.pack(*place) for k, *place in index)
    size = max(64, -(-len(keys) * BLOOM_BITS // 8) * 8)
    bloom = np.zeros(size, bool)
    for key in keys:
        bloom[bloom_bits(key, size)] = True
    bits = np.packbits(bloom, bitorder="little").tobytes()
    yield records
    yield bits
    yield _FOOTER.pack(at, len(records), at + len(records), len(bits), len(keys), ids, len(index), MAGIC)
    summary |= {"n_docs": len(keys), "n_ids": ids, "first_key": keys[0] if keys else None, "last_key": keys[-1] if keys else None}


class Shard:
    """Reads one shard: by key, with the Bloom filter and a binary search of the block index, or from end to end."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        if size < _FOOTER.size:
            raise ValueError(f"{uri}: shorter than a footer")
        i_at, i_len, b_at, b_len, self.n_docs, self.n_ids, n_blocks, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC or b_at + b_len + _FOOTER.size != size:
            raise ValueError(f"{uri}: not a shard, or cut short")
        raw = self.file.read_at(i_len, i_at)
        self.bloom = self.file.read_at(b_len, b_at)
        self.firsts, self.places, at = [], [], 0
        while at < len(raw):
            n, at = read_varint(raw, at)
            self.firsts.append(raw[at : at + n])
            self.places.append(_PLACE.unpack_from(raw, at + n))
            at += n + _PLACE.size
        if len(self.places) != n_blocks:
            raise ValueError(f"{uri}: {len(self.places)} index records, {n_blocks} blocks")

    def block(self, k: int) -> list[tuple[bytes, int, bytes]]:
        at, n, crc = self.places[k]
        data = self.file.read_at(n, at)
        if zlib.crc32(data) != crc:
            raise ValueError(f"block {k}: checksum differs")
        data, at, key, out = zstandard.ZstdDecompressor().decompress(data), 0, b"", []
        while at < len(data):
            shared, at = read_varint(data, at)
            n, at = read_varint(data, at)
            key = key[:shared] + data[at : at + n]
            start, at = read_varint(data, at + n)
            n, at = read_varint(data, at)
            out.append((key, start, data[at : at + 4 * n]))
            at += 4 * n
        return out

    def __iter__(self) -> Iterator[tuple[bytes, int, bytes]]:
        for k in range(len(self.places)):
            yield from self.block(k)

    def get(self, doc_id: int | None) -> list[bytes]:
        """The ids of each entry with this key."""
        key = key_of(doc_id)
        if any(not self.bloom[b >> 3] >> (b & 7) & 1 for b in bloom_bits(key, len(self.bloom) * 8)):
            return []
        out = []
        for k in range(max(0, bisect.bisect_left(self.firsts, key) - 1), len(self.firsts)):
            if self.firsts[k] > key:
                break
            out += [v for x, _, v in self.block(k) if x == key]
        return out


MANIFEST = "path string, n_docs long, n_ids long, first_key binary, last_key binary"


def write_shards(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int | None, folder: str | None = None, range_bytes: int = RANGE_BYTES, most_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes the texts of docs, appends end_id to each, and writes shards to a folder in shared storage.

    Returns the manifest, one row a shard: path, n_docs, n_ids, first_key, last_key. Rows are dealt out by ranges of
    doc_id, as many as range_bytes of text each ask for (or the session's number of shuffle partitions, if that is more),
    and each task encodes and writes as it reads. A shard ends before the entry that would take it over most_bytes, so
    memory holds one batch, one block and the keys of one shard, whatever a range holds. A task's files have
    names of its own attempt, and only the manifest's files count: lost and repeated tasks leave nothing behind that
    is read. Null texts are empty, null ids come first, rows that repeat an id stay side by side in an order
    of their texts' hashes, maybe over several shards, an empty table gives no shards, and other columns are ignored.
    """
    ship(spark)
    folder = folder or fresh(spark, "sstable")
    rows = docs.select("doc_id", text_of(docs).alias("text"))
    mark = F.xxhash64("text")  # so that an id which very many rows have is dealt to several shards
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = -(-size // range_bytes)
    number = [ranges] if ranges > int(spark.conf.get("spark.sql.shuffle.partitions")) else []
    rows = rows.repartitionByRange(*number, "doc_id", mark).sortWithinPartitions("doc_id", mark, "text")
    tail = b"" if end_id is None else struct.pack("<I", end_id)

    def write(batches):
        encoder = tokens.id_encoder(vocabulary)

        def entries():
            for b in batches:
                ids, borders = encoder.encode(b.column("text"))
                for k, doc_id in enumerate(b.column("doc_id").to_pylist()):
                    yield doc_id, ids[borders[k] : borders[k + 1]].astype("<u4").tobytes() + tail

        stream = entries()
        ahead = next(stream, None)

        def one_shard():
            nonlocal ahead
            held = 0
            while ahead is not None and (not held or held + ENTRY_BYTES + len(ahead[1]) <= most_bytes):
                held += ENTRY_BYTES + len(ahead[1])
                yield ahead
                ahead = next(stream, None)

        while ahead is not None:
            summary: dict = {}
            path = write_file(folder, "shard", shard_bytes(one_shard(), summary))
            row = {"path": path} | summary
            yield pa.RecordBatch.from_pylist([row], pa.schema([("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_key", pa.binary()), ("last_key", pa.binary())]))

    return settle(rows.mapInArrow(thrifty(write, ("ids", vocabulary)), MANIFEST), "manifest")


READ_BYTES = 8 << 20


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary) of every entry of the shards."""
    ship(spark)
    # One row a shard: this window is as small as the list of files.
    order = Window.orderBy("first_key", "last_key", "path").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("path", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("base"))

    def read(batches):
        names = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                rows, held = [], 0
                for key, start, ids in Shard(path):
                    rows.append((id_of(key), base + start, len(ids) // 4, ids))
                    held += len(ids)
                    if held > READ_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), names, strict=True)], schema=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), names, strict=True)], schema=names)

    spread = based.repartition(max(1, spark.sparkContext.defaultParallelism) * 4, F.xxhash64("path"))
    return spread.mapInArrow(thrifty(read), "doc_id long, start long, n_tokens long, ids binary")
