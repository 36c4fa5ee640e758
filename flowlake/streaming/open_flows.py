"""Metering with timers (T5): open flows as keyed state, closed by idle time or the end of input.

``meter_stream`` leaves the last flows of every pair in state until later packets arrive. Here each
pair's open flows are state of their own, with an event-time timer at the last packet plus the gap.
A marker row, written once when a capture ends, takes the watermark past every timer, so that all
open flows come out and the stream equals a batch run.

Packets of one task and batch become runs first (no state, no shuffle): what is shuffled is one row
per run, so a pair with a third of all packets sends few rows to its state. Runs merge with the open
flows they touch, in any order of arrival within the watermark's delay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowlake.functions.fixed import TCP_FLAGS
from flowlake.operators import metering
from flowlake.session import ship_library

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
END = "9999-01-01 00:00:00"   # time of the marker row
END_US = 253_370_764_800_000_000

PAIR_SCHEMA = "proto INT, a_ip STRING, a_port INT, b_ip STRING, b_port INT"
# A run of packets of one pair without a pause beyond the gap; sums and firsts by side.
RUN_SCHEMA = ", ".join([
    "first_us BIGINT, last_us BIGINT, first_id BIGINT, a_opened BOOLEAN",
    *[f"{s}_pkts BIGINT, {s}_bytes BIGINT, {s}_first BIGINT, {s}_last BIGINT, {s}_id BIGINT, {s}_win BIGINT"
      for s in "ab"],
    *[f"{name}_flag_cnt BIGINT" for name in TCP_FLAGS]])
RUN = [c.split()[0] for c in RUN_SCHEMA.split(", ")]
# As an object: a state's schema is needed where no session is.
STATE = T.StructType([T.StructField(*c.split()[:1], T.BooleanType() if c.endswith("BOOLEAN") else T.LongType())
                      for c in RUN_SCHEMA.split(", ")])


def packet_runs(packets: pd.DataFrame, gap_us: int) -> pd.DataFrame:
    """Runs of the packets given, by pair; packets may come in any order."""
    p = packets.astype({c: "Int64" for c in ("us", "packet_id", "bytes", "win")})
    p["pair"] = p.groupby(metering.PAIR, dropna=False, sort=False).ngroup()
    p = p.sort_values(["pair", "us", "packet_id"], kind="stable", ignore_index=True)
    starts = (p["pair"].diff() != 0) | (p["us"].diff() > gap_us).fillna(False)
    p["run"] = starts.cumsum()
    by_run = p.groupby("run", sort=True)
    first = p[starts.to_numpy()].set_index("run")
    out = first[metering.PAIR].copy()
    out["first_us"], out["last_us"] = first["us"], by_run["us"].max()
    out["first_id"], out["a_opened"] = first["packet_id"], first["from_a"]
    for s, mine in (("a", True), ("b", False)):
        side = p[p["from_a"].to_numpy(bool) == mine]
        of, opening = side.groupby("run"), side.drop_duplicates("run").set_index("run")
        out[f"{s}_pkts"] = of.size().reindex(out.index, fill_value=0)
        out[f"{s}_bytes"] = of["bytes"].sum(min_count=1).reindex(out.index)
        out[f"{s}_first"], out[f"{s}_last"] = opening["us"].reindex(out.index), of["us"].max().reindex(out.index)
        out[f"{s}_id"], out[f"{s}_win"] = opening["packet_id"].reindex(out.index), opening["win"].reindex(out.index)
    for name, bit in TCP_FLAGS.items():
        hit = p["flags"].fillna(0).astype("int64") & bit != 0
        out[f"{name}_flag_cnt"] = hit.groupby(p["run"]).sum()
    return out.reset_index(drop=True)


def _least(x, y):
    return y if x is None else x if y is None else min(x, y)


def merge(one: dict, two: dict) -> dict:
    """One run of two that touch; all its figures come from theirs."""
    first, other = (one, two) if (one["first_us"], one["first_id"]) <= (two["first_us"], two["first_id"]) else (two, one)
    out = {"first_us": first["first_us"], "first_id": first["first_id"], "a_opened": first["a_opened"],
           "last_us": max(one["last_us"], two["last_us"])}
    for s in "ab":
        out[f"{s}_pkts"] = one[f"{s}_pkts"] + two[f"{s}_pkts"]
        sizes = [x[f"{s}_bytes"] for x in (one, two) if x[f"{s}_bytes"] is not None]
        out[f"{s}_bytes"] = sum(sizes) if sizes else None
        out[f"{s}_first"] = _least(one[f"{s}_first"], two[f"{s}_first"])
        lasts = [x[f"{s}_last"] for x in (one, two) if x[f"{s}_last"] is not None]
        out[f"{s}_last"] = max(lasts) if lasts else None
        sides = [x for x in (one, two) if x[f"{s}_pkts"]]
        opening = min(sides, key=lambda x: (x[f"{s}_first"], x[f"{s}_id"]), default=one)
        out[f"{s}_id"], out[f"{s}_win"] = opening[f"{s}_id"], opening[f"{s}_win"]
    for name in TCP_FLAGS:
        out[f"{name}_flag_cnt"] = one[f"{name}_flag_cnt"] + two[f"{name}_flag_cnt"]
    return out


def merge_all(runs: list[dict], gap_us: int) -> list[dict]:
    """Runs in time order, merged where the pause between them is at most the gap."""
    out: list[dict] = []
    for run in sorted(runs, key=lambda r: (r["first_us"], r["first_id"])):
        if out and run["first_us"] - out[-1]["last_us"] <= gap_us:
            out[-1] = merge(out[-1], run)
        else:
            out.append(run)
    return out


class OpenFlows(StatefulProcessor):
    """State of a pair: its open flows. One timer, for the flow that closes first: when it fires, all
    flows that no packet can reach any more come out, and the next one to close gets the timer."""

    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", STATE)

    def _closes(self, run: dict) -> int:
        """Watermark, in milliseconds, from which the flow takes no more packets."""
        return (run["last_us"] + self.gap_us) // 1000 + 1

    def _held(self) -> list[dict]:
        return [dict(zip(RUN, row)) for row in self.open.get()] if self.open.exists() else []

    def _first(self, runs: list[dict]) -> int | None:
        return min(map(self._closes, runs), default=None)

    def _hold(self, runs: list[dict], timer: int | None) -> None:
        wanted = self._first(runs)
        if timer != wanted:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        if runs:
            self.open.put([tuple(r[c] for c in RUN) for r in runs])
        else:
            self.open.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        new = [r for r in ({c: row[c] for c in RUN} for row in rows) if r["first_us"] < END_US]
        if new:
            held = self._held()
            self._hold(merge_all(held + new, self.gap_us), self._first(held))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        now, held = timerValues.getCurrentWatermarkInMs(), self._held()
        done = [r for r in held if self._closes(r) <= now]
        if done:
            self._hold([r for r in held if self._closes(r) > now], None)
        return iter([T.Row(*metering.PAIR, *RUN)(*key, *[r[c] for c in RUN]) for r in done])

    def close(self) -> None:
        pass


def meter_open_flows(packets: DataFrame, gap_seconds: float, late: str = "10 minutes",
                     time: str = "ts") -> DataFrame:
    """T5: F2-F7, a row per flow, as in a batch run but for ``flow_seq``.

    A flow appears when the watermark passes its last packet plus the gap: when other packets have
    come so far, or after ``end_input``. State holds open flows only. Packets without a time are
    ignored; a run of packets that arrives after the watermark has passed its last one is dropped.
    The session needs the RocksDB state store (``timed_state``).
    """
    ship_library(packets.sparkSession)
    gap_us = int(gap_seconds * 1e6)

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield packet_runs(batch, gap_us)

    ends = metering.with_endpoints(packets.filter(F.col(time).isNotNull()))
    types = {"a_port": "int", "b_port": "int", "proto": "int", "bytes": "bigint", "win": "bigint", "packet_id": "bigint"}
    ends = ends.select(*[F.col(c).cast(types[c]).alias(c) if c in types else c for c in ends.columns])
    # The marker has neither endpoints nor an id; they do not matter.
    ends = ends.withColumns({"from_a": F.coalesce("from_a", F.lit(True)), "packet_id": F.coalesce("packet_id", F.lit(0).cast("bigint"))})
    run = ends.mapInPandas(runs, f"{PAIR_SCHEMA}, {RUN_SCHEMA}").withColumn("ts", F.timestamp_micros("last_us")).withWatermark("ts", late)
    done = run.groupBy(*metering.PAIR).transformWithState(
        OpenFlows(gap_us), f"{PAIR_SCHEMA}, {RUN_SCHEMA}", "Append", "EventTime")
    return metering.flow_features(done.withColumns({c: F.col(c).cast("int") for c in ("a_win", "b_win")}), metering.PAIR)


def end_input(spark: SparkSession, schema: T.StructType, path: str, time: str = "ts") -> None:
    """Mark a capture as ended: one more file in the stream's folder, whose only row has a time after all others.

    The next run of the query closes every open flow. Packets that arrive later are late.
    """
    columns = [F.lit(END).cast("timestamp").alias(f.name) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name)
               for f in schema.fields]
    spark.range(1).select(*columns).coalesce(1).write.mode("append").parquet(path)


class timed_state:
    """Queries started inside use the state store that keyed state with timers needs."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(PROVIDER, None)
        self.spark.conf.set(PROVIDER, ROCKSDB)

    def __exit__(self, *_) -> None:
        if self.before is None:
            self.spark.conf.unset(PROVIDER)
        else:
            self.spark.conf.set(PROVIDER, self.before)
