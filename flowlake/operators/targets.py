"""Labels that respect targets (J1 with P4): a flow matches a window only if it goes to one of its targets.

Windows become one row per target, and are cut into disjoint segments within each target, so that the
last window of the log wins there. A log of bounded size is an index from target and time to the
winning window, sent once to each executor: flows are neither shuffled nor multiplied. A larger log is
scanned in order together with the flows of its target (``plans/ordered.py``), so a target with a third
of all flows covers many even slices.

A window without targets is one for every address. Where several windows match a flow, by one of its
addresses or by none, the last of the log wins, as without targets.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from flowlake.functions.times import micros
from flowlake.operators.labeling import _finish
from flowlake.plans import windows
from flowlake.plans.ordered import carry_last, ordered_slices
from flowlake.scratch import materialize

ADDRESSES = ("dst_ip",)


def target_bounds(sessions: DataFrame) -> DataFrame:
    """(target, lo, hi, ord, scenario), a row per target; the target of an untargeted window is null."""
    named = F.array_distinct(F.array_compact(F.coalesce("targets", F.array().cast("array<string>"))))
    return (sessions.select(F.explode_outer(named).alias("target"), micros(F.col("start")).alias("lo"),
                            micros(F.col("end")).alias("hi"), "ord", "scenario").filter("lo <= hi"))


class TargetIndex:
    """Winning window by target and time: arrays of segments, in the order of (target, start).

    A window's place is its rank in the log, so the largest place wins.
    """

    def __init__(self, rows: list[Row]):
        ords = sorted({r["ord"] for r in rows})
        place = {o: i for i, o in enumerate(ords)}
        self.scenarios = np.array([None] * len(ords) + [None], object)
        by_target: dict[str | None, list[dict]] = {}
        for r in rows:
            self.scenarios[place[r["ord"]]] = r["scenario"]
            # The sweep's winner is named by its place.
            by_target.setdefault(r["target"], []).append({"lo": r["lo"], "hi": r["hi"], "ord": place[r["ord"]], "scenario": place[r["ord"]]})
        names = sorted(t for t in by_target if t is not None)
        self.targets, parts = pd.Index(names, dtype=object), []
        for code, target in enumerate([*names, None]):
            parts += [(code, lo, hi, win) for lo, hi, win in windows.sweep(by_target.get(target, []))]
        found = np.array(parts, np.int64).reshape(-1, 4)
        self.times = np.unique(found[:, 1])
        self.starts = found[:, 0] * (len(self.times) + 1) + np.searchsorted(self.times, found[:, 1]) + 1
        self.codes, self.ends, self.wins = found[:, 0], found[:, 2], found[:, 3]

    def _wins(self, codes: np.ndarray, us: np.ndarray) -> np.ndarray:
        """Place of the winning window per row, -1 for none."""
        if not len(self.starts):
            return np.full(len(us), -1)
        # Time as the number of starts up to it: target and time are one number, searched at once.
        at = codes * (len(self.times) + 1) + np.searchsorted(self.times, us, side="right")
        i = np.searchsorted(self.starts, at, side="right") - 1
        hit = (i >= 0) & (self.codes[i] == codes) & (us <= self.ends[i])
        return np.where(hit, self.wins[i], -1)

    def scenario(self, us: np.ndarray, addresses: Sequence[pd.Series]) -> np.ndarray:
        best = self._wins(np.full(len(us), len(self.targets)), us)
        for a in addresses:
            codes = self.targets.get_indexer(a)
            best = np.maximum(best, np.where(codes >= 0, self._wins(codes, us), -1))
        return self.scenarios[best]


def _lookup(flows: DataFrame, rows: list[Row], addresses: Sequence[str], time: str) -> DataFrame:
    shared = flows.sparkSession.sparkContext.broadcast(TargetIndex(rows))

    @F.pandas_udf("string")
    def scenario_at(at: pd.Series, *names: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scenario(at.to_numpy("int64"), names), dtype=object)

    known = F.coalesce(micros(F.col(time)), F.lit(-1 << 62))
    return flows.withColumn("_scenario", scenario_at(known, *[F.col(a) for a in addresses]))


def _as_of(flows: DataFrame, segments: DataFrame, address: str | None, time: str, out: str) -> DataFrame:
    """Adds ``out``: (ord, scenario) of the segment over each flow, of its address's or of untargeted windows."""
    columns = flows.columns
    key = F.col(address) if address else F.lit(None).cast("string")
    events = flows.select(
        key.alias("_key"), micros(F.col(time)).alias("_at"), F.lit(1).alias("_kind"),
        F.xxhash64(*[F.col(f"`{c}`") for c in columns]).alias("_spread"), F.struct(*columns).alias("_flow"),
        F.lit(None).cast(segments.select(F.struct("hi", "ord", "scenario").alias("s")).schema["s"].dataType).alias("_seg"))
    starts = segments.select(
        F.col("target").alias("_key"), F.col("lo").alias("_at"), F.lit(0).alias("_kind"), F.lit(0).cast("bigint").alias("_spread"),
        F.lit(None).cast(events.schema["_flow"].dataType).alias("_flow"), F.struct("hi", "ord", "scenario").alias("_seg"))
    order = ["_at", "_kind", "_spread"]
    carried = carry_last(ordered_slices(events.unionByName(starts), ["_key"], order, "targets"), ["_key"], order, "_seg", "_latest")
    hit = F.col("_at") <= F.col("_latest.hi")
    return carried.filter("_kind = 1").select("_flow.*", F.when(hit, F.struct("_latest.ord", "_latest.scenario")).alias(out))


def label_flows_by_target(flows: DataFrame, sessions: DataFrame, addresses: Sequence[str] = ADDRESSES,
                          time: str = "ts", broadcast_limit: int = windows.DRIVER_LIMIT) -> DataFrame:
    """Adds ``label`` (1 inside a window on one of the flow's ``addresses``) and ``scenario``.

    ``sessions`` have (ord, start, end, scenario, targets). The number of window and target pairs, which
    is counted first, decides between a search in a shared index and an ordered scan. Flows without a
    time or an address match what needs none: no window, and untargeted ones. ``ord`` tells windows
    apart, and no other window has it.
    """
    bounds = target_bounds(sessions)
    rows = windows.bounded_rows(bounds, broadcast_limit)
    if rows is not None:
        return _finish(_lookup(flows, rows, addresses, time))
    told, bounds = ["ord", "scenario"], materialize(bounds, "target-bounds")
    aimed, open_ = bounds.filter("target IS NOT NULL"), bounds.filter("target IS NULL")
    segments = materialize(windows.flatten_distributed(aimed, ["target"], told), "target-segments")
    sides = [(a, segments) for a in addresses]
    if not open_.isEmpty() or not sides:
        sides.append((None, windows.flatten_distributed(open_, winner=told).withColumn("target", F.lit(None).cast("string"))))
    joined, found = flows, []
    for i, (address, side) in enumerate(sides):
        joined, found = _as_of(joined, side, address, time, f"_win{i}"), [*found, f"_win{i}"]
    best = F.greatest(*found) if len(found) > 1 else F.col(found[0])
    return _finish(joined.withColumn("_scenario", best["scenario"]).drop(*found))
