"""Rows of a bucket as few binary values: Arrow streams of the rows' columns.

Keyed state that runs in Python takes and gives its rows one by one, some ten microseconds each. Packed, a
row of state holds thousands of rows, and what is done with them is done on whole arrays.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GATHERED_BYTES = 32 << 20   # rows that a task gathers before it packs them
BLOB_BYTES = 256 << 10      # about what one value holds


def to_blob(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def from_blob(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def _blobs(rows: pa.Table, by: str, blob_bytes: int) -> Iterator[tuple[int, bytes]]:
    keys = rows.column(by).to_numpy()
    order = np.argsort(keys, kind="stable")
    keys, rows = keys[order], rows.drop_columns([by]).take(pa.array(order)).combine_chunks()
    most = max(1, int(len(rows) * blob_bytes / max(rows.nbytes, 1)))
    edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    for i, j in zip(edges, edges[1:]):
        for start in range(i, j, most):
            yield int(keys[start]), to_blob(rows.slice(start, min(most, j - start)))


def packed(df: DataFrame, by: str, blob_bytes: int = BLOB_BYTES) -> DataFrame:
    """(``by``, blob): rows with equal ``by``, a whole number, that a task reads near each other."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for key, blob in _blobs(pa.Table.from_batches(held), by, blob_bytes):
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([blob], pa.binary())], [by, "blob"])

        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= GATHERED_BYTES:
                yield from out(held)
                held, size = [], 0
        if held:
            yield from out(held)

    return df.select(F.col(by).cast("bigint").alias(by), *[c for c in df.columns if c != by]).mapInArrow(run, f"`{by}` BIGINT, blob BINARY")


def unpacked(df: DataFrame, schema: T.StructType, blob: str = "blob") -> DataFrame:
    """The rows of all blobs, which have the columns of ``schema``."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                yield from from_blob(value.as_py()).to_batches()

    return df.select(blob).mapInArrow(run, schema)
