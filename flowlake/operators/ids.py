"""IDS event reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.functions import fixed
from flowlake.sources.ids import good_events

UNKNOWN = "?"
MALFORMED = "malformed"


def ids_event_counts(events: DataFrame,
                     types: Sequence[str] = fixed.IDS_EVENT_TYPES) -> DataFrame:
    """Events per type with zeros shown, and lines that could not be parsed."""
    bad = F.col("_corrupt").isNotNull()
    kind = F.when(bad, F.lit(MALFORMED)).otherwise(F.col("event_type"))
    names = [*types, MALFORMED]
    wanted = events.sparkSession.createDataFrame([(t,) for t in names], "event_type STRING")
    counts = (events.select(kind.alias("event_type")).filter(F.col("event_type").isin(names))
              .groupBy("event_type").agg(F.count("*").alias("n")))
    return (wanted.join(F.broadcast(counts), "event_type", "left")  # one row per listed type
            .select("event_type", F.coalesce("n", F.lit(0).cast("bigint")).alias("events")))


def alerts_only(events: DataFrame) -> DataFrame:
    return good_events(events).filter(F.col("event_type") == "alert")


def ids_alert_view(events: DataFrame) -> DataFrame:
    """Alerts for reading: time to the second, '?' for what is missing."""
    def known(path: str):
        return F.coalesce(F.col(path).cast("string"), F.lit(UNKNOWN))

    place = [c for c in ("file", "split", "line") if c in events.columns]
    return alerts_only(events).select(
        *place, F.substring(F.coalesce("timestamp", F.lit("")), 1, 19).alias("at"),
        known("src_ip").alias("src"), known("dest_ip").alias("dst"),
        known("dest_port").alias("port"), known("alert.signature").alias("signature"),
        known("alert.category").alias("category"))


def first_alerts(events: DataFrame, n: int = 3,
                 order: Sequence[str] = ("file", "split", "line")) -> DataFrame:
    """The first alerts in arrival order; each task keeps ``n`` rows."""
    return ids_alert_view(events).orderBy(*order).limit(n)


def alert_volume(events: DataFrame, bucket: str = "1 hour") -> DataFrame:
    """Alerts per time bucket, signature and category."""
    at = F.try_to_timestamp("timestamp")
    return (alerts_only(events)
            .groupBy(F.window(at, bucket).alias("w"), F.col("alert.signature").alias("signature"),
                     F.col("alert.category").alias("category"))
            .agg(F.count("*").alias("alerts"))
            .select(F.col("w.start").alias("bucket"), "signature", "category", "alerts"))
