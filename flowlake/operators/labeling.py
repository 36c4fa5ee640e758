"""Flows against attack windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.functions.numeric import safe_ratio
from flowlake.functions.times import micros
from flowlake.plans import windows
from flowlake.plans.ordered import carry_last, ordered_slices, running_totals

RANGE_JOIN_LIMIT = 64  # segments compared one by one with each flow


def _finish(joined: DataFrame) -> DataFrame:
    """A matched flow is malicious whatever the log's own label says; others get ''."""
    return (joined
            .withColumn("label", F.col("_scenario").isNotNull().cast("int"))
            .withColumn("scenario", F.coalesce(F.col("_scenario"), F.lit("")))
            .drop("_scenario"))


def _range_join(flows: DataFrame, segments: list[tuple], time: str) -> DataFrame:
    """Broadcast range join; flows are neither shuffled nor duplicated."""
    inside = micros(F.col(time)).between(F.col("_lo"), F.col("_hi"))
    build = flows.sparkSession.createDataFrame(
        segments, "_lo BIGINT, _hi BIGINT, _scenario STRING")
    return flows.join(F.broadcast(build), inside, "left").drop("_lo", "_hi")


def _lookup(flows: DataFrame, segments: list[tuple], time: str) -> DataFrame:
    """J7, bounded log: binary search in the sorted segments, sent once to each executor.

    A range join would test every segment for every flow. Spark has no search in an array,
    so this is an Arrow-batched function of the time column alone; flows are not shuffled.
    The caller has checked that the segments come from at most ``DRIVER_LIMIT`` windows.
    """
    names = sorted({s for _, _, s in segments})
    place = {n: i for i, n in enumerate(names)}
    shared = flows.sparkSession.sparkContext.broadcast((
        np.array([lo for lo, _, _ in segments], "int64"),
        np.array([hi for _, hi, _ in segments], "int64"),
        np.array([place[s] for _, _, s in segments], "int64"), np.array([*names, None], object)))

    @F.pandas_udf("string")
    def scenario_at(at: pd.Series) -> pd.Series:
        starts, ends, scenarios, texts = shared.value
        us = at.to_numpy("int64")
        i = np.searchsorted(starts, us, side="right") - 1
        hit = (i >= 0) & (us <= ends[i])
        return pd.Series(texts[np.where(hit, scenarios[i], len(texts) - 1)])

    known = F.coalesce(micros(F.col(time)), F.lit(-1 << 62))
    return flows.withColumn("_scenario", scenario_at(known))


def _as_of_join(flows: DataFrame, segments: DataFrame, time: str) -> DataFrame:
    """J7, log of any size: latest segment start at or before the flow, then its end.

    Segments are disjoint, so no other can cover the flow. The row hash spreads flows of
    one instant over slices.
    """
    columns = flows.columns
    events = flows.select(
        micros(F.col(time)).alias("_at"), F.lit(1).alias("_kind"),
        F.xxhash64(*[F.col(f"`{c}`") for c in columns]).alias("_spread"),
        F.struct(*columns).alias("_flow"), F.lit(None).cast(
            "struct<hi: bigint, scenario: string>").alias("_seg"))
    starts = segments.select(
        F.col("lo").alias("_at"), F.lit(0).alias("_kind"), F.lit(0).cast("bigint").alias("_spread"),
        F.lit(None).cast(events.schema["_flow"].dataType).alias("_flow"),
        F.struct("hi", "scenario").alias("_seg"))
    sliced = ordered_slices(events.unionByName(starts), [], ["_at", "_kind", "_spread"], "as-of")
    carried = carry_last(sliced, [], ["_at", "_kind", "_spread"], "_seg", "_latest")
    hit = F.col("_at") <= F.col("_latest.hi")
    return (carried.filter("_kind = 1")
            .select("_flow.*", F.when(hit, F.col("_latest.scenario")).alias("_scenario")))


def label_flows(flows: DataFrame, sessions: DataFrame, time: str = "ts",
                range_limit: int = RANGE_JOIN_LIMIT,
                broadcast_limit: int = windows.DRIVER_LIMIT) -> DataFrame:
    """Adds ``label`` (1 inside any window) and ``scenario`` (last window wins).

    The size of the log, which is counted first, decides the join: a range join, a
    search in a shared array, or for a log too large for that an as-of scan.
    """
    segments = windows.bounded_segments(sessions, broadcast_limit)
    if segments is None:
        everything = windows.flatten_distributed(windows.window_bounds(sessions))
        joined = _as_of_join(flows, everything, time)
    elif len(segments) > range_limit:
        joined = _lookup(flows, segments, time)
    else:
        joined = _range_join(flows, segments, time)
    return _finish(joined)


def session_match_report(flows: DataFrame, sessions: DataFrame, time: str = "ts",
                         range_limit: int = RANGE_JOIN_LIMIT) -> DataFrame:
    """Flows matched per session; sessions without a match stay, overlaps count twice."""
    bounds = windows.window_bounds(sessions)
    at = micros(F.col(time))
    rows = windows.bounded_rows(bounds, range_limit)
    if rows is not None:
        # Every flow meets every window once; partial sums leave one row per window and task.
        hits = (flows.select(at.alias("_at"))
                .join(F.broadcast(bounds), F.col("_at").between(F.col("lo"), F.col("hi")))
                .groupBy("ord").agg(F.count("*").alias("matched")))
    else:
        hits = _matches_by_running_count(flows.select(at.alias("at")), bounds)
    return (sessions.join(hits, "ord", "left")
            .withColumn("matched", F.coalesce(F.col("matched"), F.lit(0).cast("bigint"))))


def _matches_by_running_count(times: DataFrame, bounds: DataFrame) -> DataFrame:
    """Matches = flows before the end's cut minus flows before the start's cut.

    One running count over distinct instants answers all windows, however they overlap.
    """
    counts = times.filter("at IS NOT NULL").groupBy("at").agg(F.count("*").alias("n"))
    cuts = bounds.select(F.col("lo").alias("at")).union(bounds.select(F.col("hi") + 1)).distinct()
    points = (counts.withColumn("kind", F.lit(1))
              .unionByName(cuts.select("at", F.lit(0).cast("bigint").alias("n"),
                                       F.lit(0).alias("kind"))))
    running = running_totals(ordered_slices(points, [], ["at", "kind"], "counts"),
                             [], ["at", "kind"], {"seen": "n"})
    before = running.filter("kind = 0").select("at", "seen")
    return (bounds
            .join(before.select(F.col("at").alias("lo"), F.col("seen").alias("s0")), "lo")
            .join(before.select((F.col("at") - 1).alias("hi"), F.col("seen").alias("s1")), "hi")
            .select("ord", (F.col("s1") - F.col("s0")).alias("matched")))


def label_counts(labeled: DataFrame) -> DataFrame:
    """Rows, malicious, benign."""
    return labeled.agg(F.count("*").alias("total"),
                       F.count_if(F.col("label") == 1).alias("malicious"),
                       F.count_if(F.col("label") == 0).alias("benign"))


def scenario_counts(labeled: DataFrame) -> DataFrame:
    """Flows per scenario, largest first; missing and '' are not a scenario."""
    return (labeled.filter(F.col("scenario").isNotNull() & (F.col("scenario") != ""))
            .groupBy("scenario").agg(F.count("*").alias("flows"))
            .orderBy(F.desc("flows"), "scenario"))


def capture_stats(labeled: DataFrame, time: str = "ts") -> DataFrame:
    """D3: flows, class shares in percent, first and last time, duration in seconds."""
    first, last = F.min(micros(F.col(time))), F.max(micros(F.col(time)))
    total = F.count("*")
    bad = F.count_if(F.col("label") == 1)
    return labeled.agg(
        total.alias("flows"), bad.alias("malicious"), (total - bad).alias("benign"),
        F.round(safe_ratio(bad * 100, total), 6).alias("malicious_pct"),
        F.round(safe_ratio((total - bad) * 100, total), 6).alias("benign_pct"),
        first.alias("first_us"), last.alias("last_us"),
        F.round((last - first) / 1e6, 3).alias("duration_s"))


def overlap_totals(report: DataFrame, labeled: DataFrame) -> DataFrame:
    """Matches summed over windows beside the flows that are malicious once."""
    summed = report.select(F.col("matched").alias("m"), F.lit(0).alias("bad"), F.lit(0).alias("good"))
    flows = label_counts(labeled).select(F.lit(0).cast("bigint").alias("m"),
                                         F.col("malicious").alias("bad"),
                                         F.col("benign").alias("good"))
    return (summed.unionByName(flows)
            .agg(F.sum("m").alias("window_matches"), F.sum("bad").alias("malicious_flows"),
                 F.sum("good").alias("benign_flows"))
            .withColumn("counted_again", F.col("window_matches") - F.col("malicious_flows")))
