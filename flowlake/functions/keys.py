"""Seeded row keys. A key depends on the row's content alone, so a recomputed task agrees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MISSING = "\\N"  # keeps ('a', null) and (null, 'a') apart


def text_of(column: str | Column) -> Column:
    col = F.col(column) if isinstance(column, str) else column
    return F.coalesce(col.cast("string"), F.lit(_MISSING))


def row_key(seed: int, columns: Sequence[str | Column]) -> Column:
    """``md5(seed|c1|c2|...)`` as 32 hex digits."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[text_of(c) for c in columns]))


def full_row_key(df: DataFrame, seed: int) -> Column:
    """Key over every column; only identical rows share it."""
    simple = [F.col(f"`{f.name}`") if f.dataType.typeName() not in ("struct", "array", "map")
              else F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in df.schema.fields]
    return row_key(seed, simple)


def seeded_index(seed: int, draw: Column, size: Column) -> Column:
    """Index in ``[0, size)`` for a draw number: 60 bits of md5, modulo the size."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), draw.cast("string"))), 1, 15)
    return F.conv(digits, 16, 10).cast("bigint") % size


def unit_interval(key: Column) -> Column:
    """First 8 hex digits of a key as a number in ``[0, 1)``."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))
