"""Centroid clustering by vantage-point trees (operator 13).

Every round builds a vantage-point tree over the centroids, broadcasts it, and assigns each vector by
best-first branch and bound: a vector visits its open tree nodes in the order of their lower bounds,
and a node is closed only when its bound lies beyond the best distance (a bound equal to it stays
open, so that ties reach the centroid with the smaller number). Distances are exact integers; only
bounds are floating point, and they are shaved so that rounding can't close a node too early.

Vectors are written once, as integers. A task leaves one row a cluster it has met, with exact sums,
so a round shuffles (tasks x clusters) rows, and the driver gets one row a cluster. ``k`` times
``dims`` is the size of all that is broadcast or collected; it is a parameter, not data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.llm.common import bound_batches, give_back
from flowlake.scratch import materialize

DIMS, CLUSTERS, ROUNDS = 64, 8, 10
SCALE = 1024                  # a component is floor(SCALE * x)
LEAF = 2                      # centroids of a leaf
LARGEST = 1 << 27             # squared distances of 64 such components fit 64 bits
CELLS = 1 << 18               # bounds that a step holds: vectors times tree nodes
SHAVED = 1 - 1e-9             # of a lower bound, for its rounding

POINTS = "vec_id long, v binary"
SUMS = "cluster int, n long, total array<long>, inertia decimal(38,0)"


@dataclass(frozen=True)
class Node:
    """A vantage centroid with children, or a leaf. ``low`` and ``high`` bound the distances of all
    centroids below the node to the parent's vantage point; ``members`` are exact: the vantage point
    of an inner node, all centroids of a leaf."""

    members: tuple[int, ...]
    low: float
    high: float
    children: tuple[int, ...] = ()


def build_tree(centroids: np.ndarray, leaf: int = LEAF) -> list[Node]:
    """Nodes of a vantage-point tree, the root first.

    The vantage point is the centroid farthest from the one with the smallest number; the others are
    halved by their distance from it.
    """
    nodes: list[Node] = []

    def distances(at: int, others: list[int]) -> np.ndarray:
        return np.sqrt(((centroids[others] - centroids[at]) ** 2).sum(axis=1).astype(np.float64))

    def grow(members: list[int], low: float, high: float) -> int:
        place = len(nodes)
        if len(members) <= leaf:
            nodes.append(Node(tuple(members), low, high))
            return place
        nodes.append(Node((), low, high))
        vantage = members[int(distances(members[0], members).argmax())]
        rest = [m for m in members if m != vantage]
        d = distances(vantage, rest)
        order = np.argsort(d, kind="stable")
        halves = [h for h in np.array_split(order, 2) if len(h)]
        children = tuple(grow(sorted(rest[i] for i in h), float(d[h].min()), float(d[h].max())) for h in halves)
        nodes[place] = Node((vantage,), low, high, children)
        return place

    if len(centroids):
        grow(list(range(len(centroids))), 0.0, float("inf"))
    return nodes


def nearest(vectors: np.ndarray, centroids: np.ndarray, nodes: list[Node]) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of each vector, and how many exact distances that took.

    All vectors of a step advance together, each on its own open node with the least bound.
    """
    n = len(vectors)
    best, cluster = np.full(n, np.iinfo(np.int64).max), np.full(n, -1, np.int64)
    looked, step = 0, max(1, CELLS // max(len(nodes), vectors.shape[1]))
    for a in range(0, n, step):
        v, b, c = vectors[a:a + step], best[a:a + step], cluster[a:a + step]
        bounds = np.full((len(v), len(nodes)), np.inf)
        bounds[:, 0] = 0.0
        active = np.arange(len(v))
        while len(active):
            at = bounds[active].argmin(axis=1)
            bound = bounds[active, at]
            # Inclusive: a node whose bound equals the best distance may hold a tie.
            going = np.isfinite(bound) & (bound * bound * SHAVED <= b[active])
            active, at = active[going], at[going]
            bounds[active, at] = np.inf
            for node in np.unique(at):
                rows = active[at == node]
                for m in nodes[node].members:
                    d = ((v[rows] - centroids[m]) ** 2).sum(axis=1)
                    looked += len(rows)
                    closer = (d < b[rows]) | ((d == b[rows]) & (m < c[rows]))
                    b[rows[closer]], c[rows[closer]] = d[closer], m
                if nodes[node].children:
                    away = np.sqrt(d.astype(np.float64))
                    for child in nodes[node].children:
                        low = np.maximum(away - nodes[child].high, nodes[child].low - away)
                        # The rounding of the difference is relative to its terms, not to itself.
                        low -= 1e-9 * (away + nodes[child].high)
                        bounds[rows, child] = np.maximum(low, 0.0)
    return cluster, best, looked


def integer_vectors(embeddings: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): vectors with exactly ``dims`` components, none null or non-finite, as integers in 32 bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("x")
            x = np.asarray(lists.flatten(), np.float64)
            whole = np.floor(x * scale)
            if len(whole) and not np.abs(whole).max() < LARGEST:
                raise ValueError(f"a component beyond {LARGEST // scale}: squared distances would not fit 64 bits")
            v = np.ascontiguousarray(whole.astype("<i4"))
            size = 4 * dims
            offsets = np.arange(0, len(v) * 4 + 1, size, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offsets), pa.py_buffer(v)])],
                ["vec_id", "v"])
        give_back()

    bound_batches(embeddings.sparkSession)
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) != float("inf")))
    return (embeddings.filter((F.size(x) == dims) & finite)
            .select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).mapInArrow(run, POINTS))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("v")
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").astype(np.int64).reshape(len(column), -1)


def first_centroids(points: DataFrame, k: int = CLUSTERS) -> np.ndarray:
    """The ``k`` vectors with the smallest hash of their id; equal ids go by their components."""
    order = [F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), F.col("v").asc()]
    rows = points.orderBy(*order).limit(k).collect()
    return np.stack([np.frombuffer(r.v, "<i4").astype(np.int64) for r in rows]) if rows else np.empty((0, 0), np.int64)


def _sums(shared, dims: int):
    """Per task and cluster: vectors, componentwise sums, and summed distances, all exact."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        centroids, nodes = shared.value
        count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dims), np.int64)
        inertia = [0] * len(centroids)
        for batch in batches:
            v = _matrix(batch)
            if not len(v):
                continue
            cluster, d, _ = nearest(v, centroids, nodes)
            for c in np.unique(cluster).tolist():
                own = cluster == c
                count[c] += own.sum()
                total[c] += v[own].sum(axis=0)
                inertia[c] += int(d[own].sum(dtype=object))
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(met, pa.int32()), pa.array(count[met], pa.int64()), pa.array(total[met].tolist(), pa.list_(pa.int64())),
             pa.array([Decimal(inertia[c]) for c in met], pa.decimal128(38, 0))], ["cluster", "n", "total", "inertia"])
        give_back()
    return run


def _assigned(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, nodes = shared.value
        for batch in batches:
            if batch.num_rows:
                cluster, d, _ = nearest(_matrix(batch), centroids, nodes)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(d, pa.int64())],
                                                 ["vec_id", "cluster", "distance"])
        give_back()
    return run


def _exact_sum(c: Column) -> Column:
    return F.sum(c.cast("decimal(38,0)"))


def moved(points: DataFrame, centroids: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The centroids after one round: floor of the exact mean of their vectors; empty ones stay."""
    dims = centroids.shape[1]
    shared = points.sparkSession.sparkContext.broadcast((centroids, build_tree(centroids, leaf)))
    parts = points.mapInArrow(_sums(shared, dims), SUMS)
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[_exact_sum(F.get("total", F.lit(i))) for i in range(dims)]).alias("total")).collect()
    out = centroids.copy()
    for r in rows:
        out[r.cluster] = [int(t) // r.n for t in r.total]
    shared.destroy()
    return out


def clusters(embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, leaf: int = LEAF) -> DataFrame:
    """One row a kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors with ``dims`` components, none null or non-finite; of others nothing is returned.
    The first centroids are the ``k`` kept vectors with the smallest hash of their id, fewer if fewer
    are kept. Ties go to the smaller cluster number, repeated rows count each, a null vec_id is a
    vector like others (last in the order of hashes). Other columns are ignored. No kept vectors give
    no rows. Components beyond 2^27 after scaling are refused. Inertias are null beyond 64 bits.
    """
    spark = embeddings.sparkSession
    points = materialize(integer_vectors(embeddings, dims, scale), "points")
    centroids = first_centroids(points, k)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], schema)
    for _ in range(rounds):
        centroids = moved(points, centroids, leaf)
    shared = spark.sparkContext.broadcast((centroids, build_tree(centroids, leaf)))
    assigned = materialize(points.mapInArrow(_assigned(shared), "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r.cluster: int(r.d) for r in assigned.groupBy("cluster").agg(_exact_sum(F.col("distance")).alias("d")).collect()}
    fits = lambda x: x if x < 1 << 63 else None
    rows = [(c, fits(d), fits(sum(inertia.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in inertia.items()]
    of = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(of), "cluster").select(*[n.split()[0] for n in schema.split(", ")])
