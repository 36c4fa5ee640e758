"""What the training-data operators share.

A *word* is a maximal run of characters other than blank, tab, line feed, vertical tab, form
feed and carriage return. These are the bytes on which ``bytes.split()`` splits, so words are
cut on UTF-8 bytes in Python and by ``WORD`` in SQL.
"""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WHITE = b" \t\n\x0b\x0c\r"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
BATCH_BYTES = 4 << 20
PART_BYTES = 2 << 20          # text that one Python call handles at a time
BROADCAST_ROWS = 1 << 20      # keys that may be broadcast, after they were counted
HOT_ROWS = 4096               # rows from which on a key is hot, in tables of up to HOT_ROWS * BROADCAST_ROWS rows


def bound_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Arrow batches end at ``size`` bytes, however long the texts are; Python workers find this library.

    Workers that share no files with the driver get it by ``--py-files``.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def give_back() -> None:
    """Return what a Python worker no longer holds to the system; workers are kept between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def pieces(batch: pa.RecordBatch, max_bytes: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch whose ``text`` has about ``max_bytes`` bytes, one row at least."""
    text = batch.column("text")
    sizes = np.asarray(pc.fill_null(pc.binary_length(text), 0), dtype=np.int64)
    slot = np.cumsum(sizes) // max_bytes
    cuts = [0, *(np.flatnonzero(np.diff(slot)) + 1), len(slot)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of unsigned 64-bit integers (splitmix64 finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """64-bit hashes of all runs of ``k`` word hashes: a polynomial over them, mixed."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    if k <= 8:
        h = np.full(n, seed + k, np.uint64)
        for i in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + words[i:i + n]
            h ^= h >> np.uint64(29)
        return mix64(h)
    # Longer runs from halves, so that the cost grows with log k.
    half = k // 2
    left = window_hashes(words, half, seed + 1)
    if k % 2:
        rest = window_hashes(words, half + 1, seed + 1)
        return mix64(left[:n] * np.uint64(0xD6E8FEB86659FD93) + (rest[half:half + n] ^ (rest[half:half + n] >> np.uint64(31))))
    return mix64(left[:n] * np.uint64(0xD6E8FEB86659FD93) + (left[half:half + n] ^ (left[half:half + n] >> np.uint64(31))))


def hot_from(rows: int) -> int:
    """Rows above which a key of a table of ``rows`` rows is hot: at most ``BROADCAST_ROWS`` keys can be."""
    return max(HOT_ROWS, rows // BROADCAST_ROWS)


def join_counted(rows: DataFrame, keys: DataFrame, on: list[str], limit: int) -> DataFrame:
    """Rows with the columns of their keys. ``keys`` is a written table of one row a key with its count ``n``.

    Keys of over ``limit`` rows (``hot_from``) are broadcast, so that no task gets all rows of one;
    so are all keys where they are few. ``rows`` is read twice otherwise.
    """
    if keys.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keys), on)
    hot = F.broadcast(keys.filter(F.col("n") > limit))
    rest = rows.join(hot.select(on), on, "left_anti").join(keys.filter(F.col("n") <= limit), on)
    return rows.join(hot, on).unionByName(rest)
