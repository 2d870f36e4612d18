"""Token counts behind a digest cache.

A text's key is the SHA-256 of its normalised UTF-8 bytes beside the SHA-256 of the vocabulary file. Normalised are null
texts (empty) and, under a vocabulary that drops spaces, runs of spaces and those at the ends; nothing that could change
a count. Counts that the cache has are joined; only distinct misses are encoded, and appended to the cache.

The cache is laid out by vocabulary version and by the first byte of the digest. A run reads the folders of its own
digests alone, and of these the rows that it asks for; what other runs and versions left is not shuffled.

Defined results: null and empty texts have 0 bytes and 0 tokens; rows with a null or repeated doc_id are counted like
any other, row by row; an empty table gives no rows and leaves the cache as it is; extra columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import fresh, settle, ship, text_of, thrifty

CACHE_SCHEMA = "digest binary, n_tokens long, part string"
#: Digests that are sent to all tasks (some 100 bytes each in a hash table); beyond it both sides are shuffled.
FEW_DIGESTS = 250_000


def part_of(digest: str) -> Column:
    """The cache's folder for a digest: its first byte in hexadecimal."""
    return F.hex(F.substring(digest, 1, 1))


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """The cache's rows of a vocabulary version; None where there are none yet."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(f"{cache}/version={version}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def known_counts(spark: SparkSession, digests: DataFrame, cache: str, version: str) -> DataFrame | None:
    """digest, n_tokens of those digests that the cache has; None where it has no count of this version."""
    held = read_cache(spark, cache, version)
    if held is None:
        return None
    asked = settle(digests.distinct(), "digests")
    parts = [r["part"] for r in asked.select(part_of("digest").alias("part")).distinct().collect()]  # at most 256
    few = asked.count() <= FEW_DIGESTS
    mine = held.where(F.col("part").isin(parts)).join(F.broadcast(asked) if few else asked, "digest", "left_semi")
    # Two runs may have appended the same miss at the same time.
    return settle(mine.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "known")


def token_counts(spark: SparkSession, docs: DataFrame, vocabulary: str, cache: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row of docs, and cached (its count was in the cache).

    cache: a folder of Parquet files in shared storage, kept from run to run; by default a new one.
    """
    ship(spark)
    cache = cache or fresh(spark, "token-cache")
    version = tokens.version_digest(vocabulary)
    text = text_of(docs)
    same = F.trim(F.regexp_replace(text, " +", " ")) if tokens.drops_spaces(vocabulary) else text
    keyed = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(same.cast("binary"), 256)).alias("digest"), same.alias("text"))

    known = known_counts(spark, keyed.select("digest"), cache, version)
    # Texts whose count is known stay behind; copies of others within a partition meet before the shuffle, so that large
    # groups of them cost one row a partition.
    new = keyed.select("digest", "text").dropDuplicates(["digest"])
    if known is not None:
        new = new.join(known.select("digest"), "digest", "left_anti")

    def encode(batches):
        count = tokens.counter(vocabulary).count
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(count(b.column("text")), pa.int64())], ["digest", "n_tokens"])

    # Stored, so that the join below reads plain rows on both sides and Spark can split a digest that very many rows have.
    counted = settle(new.mapInArrow(thrifty(encode, ("counter" if vocabulary.endswith(".model") else "ids", vocabulary)), "digest binary, n_tokens long"), "counts")
    # Rebalanced, so that a folder gets files of a fair size: few from a small run, several tasks' from a large one.
    fresh_rows = counted.select("digest", "n_tokens", F.lit(version).alias("version"), part_of("digest").alias("part"))
    fresh_rows.hint("rebalance", "part").write.mode("append").partitionBy("version", "part").parquet(cache)

    counts = counted.withColumn("cached", F.lit(False))
    if known is not None:
        counts = counts.unionByName(known.withColumn("cached", F.lit(True)))
    joined = keyed.select("doc_id", "n_bytes", "digest").join(counts, "digest")
    return joined.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "cached")
