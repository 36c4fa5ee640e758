"""Live labels against a log that grows (T2): both sides are streams.

Attack windows are cut at fixed time buckets, so a flow meets only the pieces of its own bucket. A task
sweeps the pieces it reads first: what travels are disjoint segments, each with its newest window. Flows
and segments of a bucket are keyed state, with a timer at the bucket's end: Spark holds them until the
watermark passes it, which is ``delay`` after the newest bucket, and a window that is logged in the
meantime still labels them. Then the segments are swept once more, and each flow finds its own by binary
search and comes out once, with the last of the windows over it, or without one: n log n steps, no pair of
a flow and a window that loses. What is held is the flows and segments of open buckets, whatever the
length of the log. They are held packed, thousands to a value, and looked up by whole arrays.

A busy bucket is dealt to several tasks: flows by a salt, the few segments to each salt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowlake.functions.times import micros
from flowlake.operators.labeling import _finish
from flowlake.plans import windows
from flowlake.session import ship_library
from flowlake.streaming import packed
from flowlake.streaming.open_flows import PROVIDER, ROCKSDB

POLICY = "spark.sql.streaming.multipleWatermarkPolicy"
BUCKET_SECONDS, SALTS = 600, 8
SWEEP_ROWS = 200_000   # pieces that a task gathers before it sweeps them
BLOB = T.StructType([T.StructField("blob", T.BinaryType())])
NEVER = np.iinfo(np.int64).min
NOTHING = np.empty(0, np.int64), np.array([NEVER]), pa.array([None], pa.string())


def _bucket_end(us: Column, size: int) -> Column:
    return F.timestamp_micros((F.floor(us / F.lit(size)) + 1) * size)


def window_pieces(log: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """(bucket, lo, hi, ord, scenario): each window cut at the buckets' borders."""
    size = bucket_seconds * 1_000_000
    bounds = log.select(micros(F.col("start")).alias("lo"), micros(F.col("end")).alias("hi"), "ord", "scenario").filter("lo <= hi")
    buckets = F.sequence(F.floor(F.col("lo") / size), F.floor(F.col("hi") / size))
    cut = bounds.select("lo", "hi", "ord", "scenario", F.explode(buckets).alias("bucket"))
    return cut.withColumn("bucket", F.timestamp_micros((F.col("bucket") + 1) * size))


def bucket_segments(pieces: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """(bucket, lo, hi, ord, scenario): pieces within their bucket, disjoint as far as one task sees them.

    Windows without a place in the log never win.
    """
    size, end = bucket_seconds * 1_000_000, micros(F.col("bucket"))
    inside = pieces.filter("ord IS NOT NULL").select(
        end.alias("end"), F.greatest("lo", end - size).alias("lo"), F.least("hi", end - 1).alias("hi"), "ord", "scenario")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def ready(rows: list[pd.DataFrame]) -> pd.DataFrame:
            ranked = pd.concat(rows).sort_values(["end", "ord", "scenario"], na_position="first", kind="stable", ignore_index=True)
            return windows.swept(ranked, ["end"], joined=True)

        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) > SWEEP_ROWS:
                held = [ready(held)]
                if len(held[0]) > SWEEP_ROWS // 2:
                    yield held.pop()
        if held:
            yield ready(held)

    return inside.mapInPandas(run, inside.schema).withColumn("bucket", F.timestamp_micros("end")).drop("end")


class OpenBucket(StatefulProcessor):
    """State of a bucket and salt: its flows (``lo`` and columns) and segments (lo, hi, ord, scenario), packed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flows, self.segments = (handle.getListState(name, BLOB) for name in ("flows", "segments"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        flows, segments = [], []
        for row in rows:
            (segments if row["window"] else flows).append((bytes(row["blob"]),))
        for state, new in ((self.flows, flows), (self.segments, segments)):
            if new:
                state.appendList(new)
        self.handle.registerTimer(key[0] // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        logged, flows = ([bytes(r[0]) for r in s.get()] if s.exists() else [] for s in (self.segments, self.flows))
        self.segments.clear()
        self.flows.clear()
        if not flows:
            return
        lo, hi, scenarios = newest_over(pa.concat_tables(map(packed.from_blob, logged)).to_pandas()) if logged else NOTHING
        for blob in flows:
            table = packed.from_blob(blob)
            at = table.column("lo").to_numpy()
            place = np.searchsorted(lo, at, side="right") - 1
            hit = (place >= 0) & (at <= hi[place])
            yield T.Row("blob")(packed.to_blob(table.drop_columns(["lo"]).append_column(
                "_scenario", scenarios.take(pa.array(np.where(hit, place, len(lo)))))))

    def close(self) -> None:
        pass


def newest_over(logged: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Disjoint (lo, hi, scenario) of segments, in time order; after the last scenario comes none."""
    found = windows.swept(logged.sort_values(["ord", "scenario"], na_position="first", kind="stable", ignore_index=True), [], joined=True)
    # One more end, below all times: the place before the first start is the last.
    return (found["lo"].to_numpy(), np.append(found["hi"].to_numpy(), NEVER), pa.array([*found["scenario"], None], pa.string()))


def label_growing(flows: DataFrame, log: DataFrame, delay: str = "10 minutes", time: str = "ts",
                  bucket_seconds: int = BUCKET_SECONDS, salts: int = SALTS) -> DataFrame:
    """J1 and J2 on two streams: ``flows``, and ``log`` with (ord, start, end, scenario).

    Every flow comes out once, when the watermark has passed its bucket; copies of a flow each do.
    Flows without a time are ignored, flows of closed buckets are late and dropped, and so are pieces of
    a window that reach closed buckets. The query runs inside ``newest_stream_leads``.
    """
    ship_library(flows.sparkSession)
    size, fields = bucket_seconds * 1_000_000, flows.schema.fields
    kept = [F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(fields)]
    left = flows.filter(F.col(time).isNotNull()).select(
        micros(_bucket_end(micros(F.col(time)), size)).alias("end"), micros(F.col(time)).alias("lo"), *kept)
    right = bucket_segments(window_pieces(log, bucket_seconds), bucket_seconds).select(
        micros(F.col("bucket")).alias("end"), "lo", "hi", "ord", "scenario")
    dealt = packed.packed(left, "end").select(
        "*", F.pmod(F.xxhash64("blob"), F.lit(salts)).cast("int").alias("salt"), F.lit(False).alias("window"))
    copied = packed.packed(right, "end").select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(True).alias("window"))
    both = dealt.unionByName(copied).withColumn("bucket", F.timestamp_micros("end")).withWatermark("bucket", delay)
    done = both.groupBy("end", "salt").transformWithState(OpenBucket(), BLOB, "Append", "EventTime")
    found = T.StructType([*[T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)], T.StructField("_scenario", T.StringType())])
    return _finish(packed.unpacked(done, found).select(*[F.col(f"c{i}").alias(f.name) for i, f in enumerate(fields)], "_scenario"))


class newest_stream_leads:
    """Queries started inside advance by the stream that is further on: a quiet log holds no flow back.

    They use the state store that keyed state with timers needs.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = {POLICY: self.spark.conf.get(POLICY, "min"), PROVIDER: self.spark.conf.get(PROVIDER, None)}
        self.spark.conf.set(POLICY, "max")
        self.spark.conf.set(PROVIDER, ROCKSDB)

    def __exit__(self, *_) -> None:
        for name, value in self.before.items():
            if value is None:
                self.spark.conf.unset(name)
            else:
                self.spark.conf.set(name, value)
