"""Numeric clean-up expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC_TYPES = ("byte", "short", "integer", "long", "float", "double", "decimal")

# Fixed value: letters that cannot occur in decimal number text ('e' marks an exponent).
# It keeps out '1d', '0x1p3', 'inf' and 'nan', which a cast would take.
NOT_DECIMAL_TEXT = "[A-DF-Za-df-z]"


def inf_to_null(c: Column) -> Column:
    """P5: infinity and NaN become missing."""
    bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(~bad, c)


def coerce_numeric(c: Column) -> Column:
    """Text to double; text that is not a finite decimal number becomes missing."""
    number = F.when(~c.rlike(NOT_DECIMAL_TEXT), c.try_cast("double"))
    return inf_to_null(number)


def is_float(df: DataFrame, name: str) -> bool:
    return dict(df.dtypes)[name] in ("double", "float")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() in NUMERIC_TYPES]


def clean_columns(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """P5 over float columns (all of them by default)."""
    chosen = set(df.columns if columns is None else columns)
    return df.select(*[
        inf_to_null(F.col(c)).alias(c) if c in chosen and is_float(df, c) else F.col(c)
        for c in df.columns])


def coerce_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """P6 over the text columns among ``columns``; identifiers and scenario stay untouched."""
    types = dict(df.dtypes)
    chosen = {c for c in columns if types.get(c) == "string"}
    return df.select(*[
        coerce_numeric(F.col(c)).alias(c) if c in chosen else F.col(c) for c in df.columns])


def safe_ratio(top: Column, bottom: Column) -> Column:
    """Quotient, null where the divisor is zero."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))
