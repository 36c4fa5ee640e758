"""Attack windows as disjoint segments.

Windows are closed on both ends and may overlap; where they do, the last row of the log
wins. Cutting the time line at every start and one microsecond after every end gives
segments that each have one winner, so a flow matches at most one segment and no
de-duplication of flows is needed afterwards.

A log of bounded size is swept on the driver and becomes a local relation. A log beyond
``DRIVER_LIMIT`` rows is cut by Spark.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.functions.times import micros
from flowlake.scratch import materialize
from flowlake.session import ship_library

DRIVER_LIMIT = 100_000  # windows; about 10 MB as rows, also the bound of what is broadcast
PIECE_CUTS = 100_000    # starts and ends in a slice of the distributed cut
FEW = 32                # windows that are swept one by one
SAMPLED = 50            # of these, how many go into the sample for the slices' borders


def window_bounds(sessions: DataFrame) -> DataFrame:
    """(lo, hi, ord, scenario): closed bounds in microseconds."""
    return sessions.select(micros(F.col("start")).alias("lo"), micros(F.col("end")).alias("hi"),
                           "ord", "scenario").filter("lo <= hi")


def bounded_rows(df: DataFrame, limit: int = DRIVER_LIMIT) -> list[Row] | None:
    """All rows if there are at most ``limit``, else None."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def sweep(windows: list[Row]) -> Iterator[tuple[int, int, str]]:
    """Disjoint (lo, hi, scenario) of a bounded list of windows, in time order."""
    opening: dict[int, list[int]] = {}
    cuts = set()
    newest_last = sorted(range(len(windows)), key=lambda i: windows[i]["ord"])
    for place, i in enumerate(newest_last):
        opening.setdefault(windows[i]["lo"], []).append(-place)
        cuts.update((windows[i]["lo"], windows[i]["hi"] + 1))
    ordered = sorted(cuts)
    active: list[int] = []
    for lo, after in zip(ordered, ordered[1:]):
        for place in opening.get(lo, ()):
            heapq.heappush(active, place)
        while active and windows[newest_last[-active[0]]]["hi"] < lo:
            heapq.heappop(active)
        if active:
            yield lo, after - 1, windows[newest_last[-active[0]]]["scenario"]


def _borders(bounds: DataFrame, keys: Sequence[str], piece_cuts: int) -> dict[tuple, np.ndarray]:
    """Ascending borders of each key that is cut into slices, about ``piece_cuts`` starts and ends apart.

    They come from a sample, about ``SAMPLED`` a slice, and decide how the work is dealt, not what comes out.
    """
    cuts = 2 * bounds.count()
    if cuts <= piece_cuts:
        return {}
    points = bounds.select(*keys, F.explode(F.array("lo", F.col("hi") + 1)).alias("at"))
    share = min(1.0, SAMPLED / piece_cuts)
    found = sorted((tuple(r)[:-1], r["at"]) for r in points.sample(share, 42).collect())
    out: dict[tuple, list[int]] = {}
    step = max(1, round(piece_cuts * share))
    for key, at in found[step::step]:
        out.setdefault(key, []).append(at)
    return {key: np.unique(np.array(at, np.int64)) for key, at in out.items()}


def _highest(first: np.ndarray, after: np.ndarray, rank: np.ndarray, n: int) -> np.ndarray:
    """Per place 0..n-1 the highest rank of a run [first, after) over it, -1 for none."""
    best = np.full(n, -1, np.int64)
    level = np.log2(after - first).astype(np.int64)
    # A run is two that overlap, each of a power of two; from the longest down, each is halved.
    for k in range(n.bit_length() - 1, -1, -1):
        half = best.copy()
        np.maximum(half[1 << k:], best[:max(n - (1 << k), 0)], out=half[1 << k:])
        best, at = half, level == k
        np.maximum.at(best, first[at], rank[at])
        np.maximum.at(best, after[at] - (1 << k), rank[at])
    return best


def _cut_at(lo: np.ndarray, hi: np.ndarray, rank: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, ...]:
    """(slice, lo, hi, rank) of windows cut at borders; of those over a whole slice only the highest rank."""
    a, b = (np.searchsorted(borders, x, side="right") for x in (lo, hi))
    ends = np.append(borders, np.iinfo(np.int64).max)
    parts = [(a, lo, np.minimum(hi, ends[a] - 1), rank)]
    more = b > a
    parts.append((b[more], borders[b[more] - 1], hi[more], rank[more]))
    wide = b > a + 1
    if wide.any():
        best = _highest(a[wide] + 1, b[wide], rank[wide], len(borders) + 1)
        whole = np.flatnonzero(best >= 0)
        parts.append((whole, borders[whole - 1], borders[whole] - 1, best[whole]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _pieces(bounds: DataFrame, keys: list[str], borders: dict[tuple, np.ndarray]) -> DataFrame:
    """Windows cut into slices, with ``_slice``; a batch sends one row for equal bounds."""
    cut_keys = list(borders)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # A row's place is its rank in the log.
            batch = batch.sort_values(["_told", "ord", "scenario"], na_position="first", kind="stable", ignore_index=True)
            lo, hi = (batch[c].to_numpy(np.int64) for c in ("lo", "hi"))
            rank = np.arange(len(batch))
            if not keys:
                code = np.zeros(len(batch), np.int64) if cut_keys else np.full(len(batch), -1)
            else:
                named = pd.Index([k[0] for k in cut_keys]) if len(keys) == 1 else pd.MultiIndex.from_tuples(cut_keys) if cut_keys else pd.Index([])
                code = named.get_indexer(batch[keys[0]] if len(keys) == 1 else pd.MultiIndex.from_frame(batch[keys]))
            rest = code < 0
            parts = [(np.zeros(rest.sum(), np.int64), lo[rest], hi[rest], rank[rest])]
            for c in np.unique(code[~rest]):
                at = code == c
                parts.append(_cut_at(lo[at], hi[at], rank[at], borders[cut_keys[c]]))
            places, starts, ends, ranks = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(ranks, kind="stable")
            out = batch.take(ranks[order]).reset_index(drop=True)
            out["_slice"], out["lo"], out["hi"] = places[order], starts[order], ends[order]
            yield out.drop_duplicates([*keys, "_slice", "lo", "hi"], keep="last")

    return bounds.mapInPandas(run, T.StructType([*bounds.schema.fields, T.StructField("_slice", T.LongType())]))


def _starts(rows: pd.DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Places at which a run of equal ``columns`` starts, but for the first."""
    other = np.zeros(max(len(rows) - 1, 0), bool)
    for c in columns:
        x = rows[c].to_numpy()
        other |= x[1:] != x[:-1]
    return np.flatnonzero(other) + 1


def _swept_run(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``sweep`` by whole arrays: disjoint (lo, hi) and the place of the window, the newest being last."""
    if len(lo) < FEW:
        found = list(sweep([{"lo": a, "hi": b, "ord": i, "scenario": i} for i, (a, b) in enumerate(zip(lo.tolist(), hi.tolist()))]))
        return tuple(np.array([f[x] for f in found], np.int64) for x in range(3))
    cuts = np.unique(np.concatenate([lo, hi + 1]))
    best = _highest(np.searchsorted(cuts, lo), np.searchsorted(cuts, hi + 1), np.arange(len(lo)), len(cuts) - 1)
    over = best >= 0
    return cuts[:-1][over], cuts[1:][over] - 1, best[over]


def swept(rows: pd.DataFrame, columns: Sequence[str], joined: bool = False) -> pd.DataFrame:
    """Disjoint segments of windows within each run of equal ``columns``; in a run the newest window is last.

    ``joined``: segments of one window that follow each other become one.
    """
    edges = [0, *_starts(rows, columns).tolist(), len(rows)]
    lo, hi = (rows[c].to_numpy(np.int64) for c in ("lo", "hi"))
    found = []
    for i, j in zip(edges, edges[1:]):
        start, end, place = _swept_run(lo[i:j], hi[i:j])
        if joined and len(start):
            fresh = np.concatenate([[True], (place[1:] != place[:-1]) | (start[1:] != end[:-1] + 1)])
            start, end, place = start[fresh], end[np.append(np.flatnonzero(fresh)[1:] - 1, len(end) - 1)], place[fresh]
        found.append((start, end, place + i))
    start, end, place = (np.concatenate(x) for x in zip(*found))
    out = rows.take(place).reset_index(drop=True)
    out["lo"], out["hi"] = start, end
    return out


def _swept_slices(columns: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``swept`` over a task's sorted pieces; beside a batch only the slice at its end is held."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            starts = _starts(batch, columns)
            fresh = held and any(held[-1][c].iloc[-1] != batch[c].iloc[0] for c in columns)
            if fresh or len(starts):
                last = starts[-1] if len(starts) else 0
                yield swept(pd.concat([*held, batch.iloc[:last]]), columns)
                held = [batch.iloc[last:]]
            else:
                held.append(batch)
        if held:
            yield swept(pd.concat(held), columns)

    return run


def flatten_distributed(bounds: DataFrame, keys: Sequence[str] = (), winner: Sequence[str] = ("scenario",),
                        piece_cuts: int = PIECE_CUTS) -> DataFrame:
    """Disjoint segments for a log of any size, within each value of ``keys``: (keys..., lo, hi, scenario).

    The time line of a key with many windows is cut into slices of about ``piece_cuts`` starts and ends.
    A window becomes at most two pieces, in the slices of its ends; of the windows over a whole slice only
    the newest matters, and each batch of windows sends one. Every slice is then swept by itself: rows in
    proportion to the log, and a task holds one slice. ``winner`` names what is told of the winning window,
    of ``ord`` and ``scenario``. Windows with a missing key are left out.
    """
    ship_library(bounds.sparkSession)
    keys, known = list(keys), F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    # A missing place in the log is below all others, and whole numbers stay whole in pandas.
    blank = F.lit(0).cast(bounds.schema["ord"].dataType)
    told = bounds.filter(known).select(*keys, "lo", "hi", F.coalesce("ord", blank).alias("ord"), "scenario",
                                       F.col("ord").isNotNull().alias("_told"))
    held = materialize(told, "bounds")
    pieces = _pieces(held, keys, _borders(held, keys, piece_cuts))
    slices = [*keys, "_slice"]
    dealt = pieces.repartition(*slices).sortWithinPartitions(*slices, "_told", "ord", "scenario")
    out = dealt.mapInPandas(_swept_slices(slices), dealt.schema).withColumn("ord", F.when(F.col("_told"), F.col("ord")))
    return out.select(*keys, "lo", "hi", *winner)


def bounded_segments(sessions: DataFrame, limit: int = DRIVER_LIMIT) -> list[tuple] | None:
    """Disjoint segments in time order, or None for a log of more than ``limit`` windows."""
    rows = bounded_rows(window_bounds(sessions), limit)
    return None if rows is None else list(sweep(rows))
