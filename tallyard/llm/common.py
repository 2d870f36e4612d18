"""What the corpus operators share: shared storage, files in it, texts and ids."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Hashable

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyard.sources.shipping import ship  # noqa: F401
from tallyard.sources.storage import shared_dir


def fresh(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; nothing is ever written twice to one path."""
    return f"{shared_dir(spark)}/tallyard-{tag}-{uuid.uuid4().hex}"


def settle(df: DataFrame, tag: str, compression: str | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends here, and lost executors cost nothing."""
    spark = df.sparkSession
    path = fresh(spark, tag)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder or file in shared storage, for tasks that write files of their own format."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, name: str, chunks) -> str:
    """Writes one file under a name of this attempt's own, so that retried and speculative tasks never meet; returns its uri."""
    fs, folder = open_fs(uri)
    fs.create_dir(folder, recursive=True)
    own = f"{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(f"{folder}/{own}") as out:
        for chunk in chunks:
            out.write(chunk)
    return f"{uri}/{own}"


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(df[column], F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z alone."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 when divided by 3; null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def free_names(wanted: list[str], taken: list[str]) -> list[str]:
    """Names for columns of our own beside those taken, in any case: as wanted, with underscores where that is taken."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


# ---- memory of Python workers, which live longer than their tasks

_RESIDENT: dict[Hashable, object] = {}


def resident(key: Hashable, make: Callable[[], object]) -> object:
    """A large object that stays with the worker process from task to task, in place of whatever stayed there before."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def let_go(key: Hashable | None = None) -> None:
    """Drops what stays with the worker, but for key, and gives memory that is no longer used back to the system."""
    for other in [k for k in _RESIDENT if k != key]:
        del _RESIDENT[other]
    pa.default_memory_pool().release_unused()
    trim = _trimmer()
    if trim:
        trim(0)


@functools.cache
def _trimmer():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def thrifty(task, key: Hashable | None = None):
    """task over batches, in a worker that keeps nothing of earlier stages (but for key) and little of this one."""

    def run(batches):
        let_go(key)
        try:
            yield from task(batches)
        finally:
            let_go(key)

    return run
