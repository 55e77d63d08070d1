"""Shared helpers of the ``llm`` operators: Arrow columns as byte arrays,
bounded work units inside a task, hash-ordered samples and label folds."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bytes of text handled at once inside a task; bounds the numpy temporaries.
CHUNK_BYTES = 1 << 19


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod`` (null id: null)."""
    return F.crc32(F.col(col).cast("string")) % F.lit(mod)


def hash01(col: str, seed: int) -> Column:
    """Deterministic uniform number in [0, 1) per id and seed."""
    h = F.xxhash64(F.lit(seed), F.col(col))
    return F.pmod(h, F.lit(1 << 40)).cast("double") / F.lit(float(1 << 40))


def utf8(arr: pa.Array) -> tuple[memoryview, np.ndarray, np.ndarray]:
    """(view of the data, offsets[n+1], is_valid[n]) of a string column, not copied; null
    reads as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    valid = np.ones(len(arr), bool)
    if arr.null_count:
        valid = ~np.asarray(arr.is_null())
        arr = arr.fill_null("")
    if len(arr) == 0:
        return memoryview(b""), np.zeros(1, np.int64), valid
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + len(arr) + 1]
    buf = arr.buffers()[2]
    base, end = int(off[0]), int(off[-1])
    data = memoryview(buf)[base:end] if buf is not None else memoryview(b"")
    return data, off - base, valid


def chunks(offsets: np.ndarray, max_bytes: int = CHUNK_BYTES):
    """Row ranges [i, j) of about ``max_bytes`` (one row at least: a row is never cut)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + max_bytes, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def texts_of(data: memoryview, off: np.ndarray, i: int, j: int) -> list[bytes]:
    return [bytes(data[off[k]:off[k + 1]]) for k in range(i, j)]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mixer on uint64 (wraps around)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_key(col: str) -> Column:
    """128 bits (binary) that tell apart different texts; a null text reads as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(col), F.lit("")).cast("binary")))


def release(spark) -> None:
    """Let Spark's cleaner drop the shuffle files of finished jobs now: it acts when the
    driver collects garbage, which a driver with little to do seldom does."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def labelled(labels: DataFrame, col: str, mod: int = 5, held_out: int = 0) -> DataFrame:
    """(doc_id, y) of the learning fold: null ids and labels dropped, one row per id
    (label 1 wins), crc32 fold ``held_out`` left out."""
    return (labels.select("doc_id", F.col(col).cast("int").alias("y"))
            .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull()
                   & (crc_mod("doc_id", mod) != held_out))
            .groupBy("doc_id").agg(F.max("y").alias("y")))


def sample_ids(ids: DataFrame, n: int, seed: int) -> DataFrame:
    """At most ``n`` rows, those with the smallest id hash: the same rows for any
    partitioning. ``n`` is the documented bound that makes a broadcast safe."""
    return ids.orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), "doc_id").limit(n)


def free_name(taken, name: str) -> str:
    """``name``, with underscores in front until no column (in any case) is called so."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def give_back() -> None:
    """Return what a finished task no longer uses to the system: Python workers live on between the
    stages of a job, and the allocators keep freed memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run):
    """An Arrow function of a task that gives its memory back at the end."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()
    return wrapped
