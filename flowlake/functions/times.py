"""Time expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def epoch_to_ts(c: Column) -> Column:
    """Epoch seconds (float) to a UTC timestamp, to the microsecond; not finite is missing."""
    finite = F.when(~(F.isnan(c) | (F.abs(c) == F.lit(float("inf")))), c)
    return F.timestamp_micros(F.round(finite * 1_000_000).cast("bigint"))


def with_flow_time(flows: DataFrame, column: str = "timestamp", out: str = "ts") -> DataFrame:
    """Adds the event time; a table without the column is refused."""
    if column not in flows.columns:
        raise ValueError(f"no '{column}' column; found {flows.columns[:10]}")
    return flows.withColumn(out, epoch_to_ts(F.col(column).cast("double")))


def micros(c: Column) -> Column:
    """Timestamp to whole microseconds since the epoch."""
    return F.unix_micros(c.cast("timestamp"))


def shift_hours(c: Column, hours: int) -> Column:
    """Manual shift of local wall-clock time to UTC."""
    return c + F.expr(f"INTERVAL {int(hours)} HOURS")
