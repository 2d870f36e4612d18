"""WARC archives compressed with zstd: one frame a record, and the dictionary in the skippable frame that leads the file.

Records are response records, or revisits of one with an equal payload. The reader loads the dictionary, decodes frame
by frame, and refuses records with a wrong version line, missing or malformed headers, lengths that differ from the
bytes there, or payloads that differ from their digest.

Defined results: null html is an empty payload; a null page_id or url has no header; a url comes back
percent-encoded where it has characters that a header can't hold; of rows that repeat the largest
page_id of equal payloads all are responses; null page_ids are never the largest unless there are no others; an empty
table gives no archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, open_fs, settle, ship, thrifty, write_file

MAGIC = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
SAMPLE_PAGES = 400
SAMPLE_PAGE_BYTES = 64 << 10
ARCHIVE_BYTES = 256 << 20
REVISIT_BYTES = 1000
CHUNK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def dictionary(samples: list[bytes]) -> bytes:
    """A zstd dictionary from a bounded sample; where there is too little to train on, the sample's own bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES] or b"WARC/1.1\r\nHTTP/1.1 200 OK\r\n"


def _dict(data: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(data)


def target(url: str) -> str:
    """A url as it can stand in a header."""
    return urllib.parse.quote(url, safe="%/:?#[]@!$&'()*+,;=-._~")


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, keeper: int | None) -> bytes:
    """One WARC record; with keeper, a revisit of that page's response, without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if keeper is not None else http + payload
    head = [
        ("WARC-Type", "response" if keeper is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{page_id}>" if page_id is not None else f"<urn:sha1:{digest.hex()}>"),
        ("WARC-Date", DATE),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", target(url)))
    if keeper is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{keeper}>")]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def archive(dictionary_bytes: bytes, records: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of one archive."""
    yield struct.pack("<II", MAGIC, len(dictionary_bytes)) + dictionary_bytes
    squeeze = zstandard.ZstdCompressor(level=3, dict_data=_dict(dictionary_bytes))
    for r in records:
        yield squeeze.compress(r)


def frames(file) -> Iterator[bytes]:
    """Each record of an open archive; memory holds one of them and a chunk."""
    head = file.read(8)
    if len(head) < 8 or struct.unpack("<II", head)[0] != MAGIC:
        raise ValueError("no dictionary frame leads the archive")
    size = struct.unpack("<II", head)[1]
    data = file.read(size)
    if len(data) != size:
        raise ValueError("the dictionary is cut short")
    engine = zstandard.ZstdDecompressor(dict_data=_dict(data))
    left = b""
    while True:
        left = left or file.read(CHUNK)
        if not left:
            return
        one, parts = engine.decompressobj(), []
        while True:
            parts.append(one.decompress(left))
            if one.eof:
                left = one.unused_data
                break
            left = file.read(CHUNK)
            if not left:
                raise ValueError("the last frame is cut short")
        yield b"".join(parts)


def parse(data: bytes) -> dict:
    """Fields of one record, after all its checks."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC version line")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"malformed header: {line!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("Content-Length differs from the block")
    http, mark, payload = rest[:-4].partition(b"\r\n\r\n")
    status, *lines = http.decode().split("\r\n")
    own = dict(x.lower().split(": ", 1) for x in lines)
    if not mark or not status.startswith("HTTP/") or not own.get("content-length", "").isdigit():
        raise ValueError("the block is no HTTP response")
    digest = base64.b32decode(fields.get("warc-payload-digest", "").removeprefix("sha1:"))
    page = lambda x: int(x.removeprefix("<urn:page:").removesuffix(">")) if x.startswith("<urn:page:") else None
    out = {"page_id": page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "payload_bytes": int(own["content-length"]), "payload_digest": digest.hex(), "refers_to": None, "payload": None}
    if out["record_type"] == "response":
        if len(payload) != out["payload_bytes"] or hashlib.sha1(payload).digest() != digest:
            raise ValueError("the payload differs from its length or digest")
        return out | {"payload": payload}
    if out["record_type"] != "revisit" or payload or "warc-refers-to" not in fields:
        raise ValueError("a revisit has a payload, or nothing that it refers to")
    return out | {"refers_to": page(fields["warc-refers-to"])}


def write_archives(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes a record per row of pages; returns the archives: path, n_records. Files of lost attempts are not listed."""
    ship(spark)
    folder = folder or fresh(spark, "warc")
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).alias("size"), F.unhex(F.sha1(payload)).alias("digest"))
    # Digests are drawn first, so that partitions send a few of these, and only the drawn pages' payloads follow.
    sized = rows.where(F.col("size").between(1, SAMPLE_PAGE_BYTES))
    drawn = [bytes(r["digest"]) for r in sized.select(F.xxhash64("digest").alias("x"), "digest").distinct().orderBy("x", "digest").limit(SAMPLE_PAGES).collect()]
    sample = sized.where(F.col("digest").isin(drawn)).groupBy("digest").agg(F.any_value("payload").alias("payload")).orderBy("digest").collect() if drawn else []
    trained = spark.sparkContext.broadcast(dictionary([bytes(r["payload"]) for r in sample]))

    shared = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("keeper")).where("n > 1").drop("n")
    shared = settle(shared, "payloads")  # plain rows on both sides of the join, so that Spark can split a large group
    keeper = F.when((F.col("size") >= REVISIT_BYTES) & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    rows = rows.join(shared, "digest", "left").select("page_id", "url", "payload", "digest", keeper.alias("keeper"))

    def write(batches):
        def records():
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "keeper")), strict=True)

        stream = records()
        one = next(stream, None)
        while one is not None:
            count = 0

            def some():
                nonlocal one, count
                room = ARCHIVE_BYTES
                while one is not None and room > 0:
                    data = record(*one)
                    room -= len(data)
                    count += 1
                    yield data
                    one = next(stream, None)

            path = write_file(folder, "pages.warc.zst", archive(trained.value, some()))
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64())], ["path", "n_records"])

    return settle(rows.mapInArrow(thrifty(write), "path string, n_records long"), "archives")


RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def read_archives(spark: SparkSession, archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the archives listed in path: page_id, url, record_type, payload_bytes, payload_digest (hex),
    refers_to, and payload (null for revisits) unless it is not wanted; then it is checked all the same."""
    ship(spark)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), *([("payload", pa.binary())] if payloads else [])])

    def read(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                fs, place = open_fs(path)
                with fs.open_input_stream(place) as file:
                    rows, held = [], 0
                    for data in frames(file):
                        rows.append(parse(data))
                        held += len(data) if payloads else 300
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    listed = archives.select("path").repartition(4 * spark.sparkContext.defaultParallelism, F.xxhash64("path"))
    return listed.mapInArrow(thrifty(read), RECORD + ", payload binary" * payloads)
