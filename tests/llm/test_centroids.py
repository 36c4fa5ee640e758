"""Centroid clustering against Lloyd's rounds over all distances, in whole Python numbers."""

import hashlib
import random

import numpy as np
import pytest

from flowlake.llm.centroids import build_tree, clusters, integer_vectors, nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k, rounds):
    """{row number: (vec_id, cluster, distance, cluster_inertia, inertia, digest)} of the kept rows."""
    points = {i: (d, [int(np.floor(1024 * float(x))) for x in e]) for i, (d, e) in enumerate(rows)}
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    order = sorted(points, key=lambda i: hashlib.sha256(f"3:{points[i][0]}".encode()).hexdigest())
    centroids = [points[i][1] for i in order[:k]]
    assign = lambda: {i: min((away(v, c), j) for j, c in enumerate(centroids)) for i, (_, v) in points.items()}
    for _ in range(rounds):
        of = assign()
        for j in range(len(centroids)):
            own = [points[i][1] for i in points if of[i][1] == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    of = assign()
    total = sum(d for d, _ in of.values())
    out = []
    for i, (vec, _) in points.items():
        d, j = of[i]
        out.append((vec, j, d, sum(x for x, y in of.values() if y == j), total, hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()))
    return sorted(out)


def gotten(df):
    return sorted((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_rounds_as_plain(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(i % 5, 0.7) for _ in range(64)]) for i in range(300)]
    rows = [(i, np.float32(v).tolist()) for i, v in rows]
    docs = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    assert gotten(clusters(docs, rounds=4)) == plain(rows, 8, 4)


def test_ties_repeats_and_empty_clusters(spark):
    """Few different vectors: equal centroids stay empty, and ties go to the smaller number."""
    rows = [(i, [float(i % 3)] * 64) for i in range(60)] + [(100 + i, [0.5] * 64) for i in range(9)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    got = gotten(clusters(docs, rounds=3))
    assert got == plain(rows, 8, 3)
    same = spark.createDataFrame([(i, [1.0] * 64, 0) for i in range(40)], SCHEMA)
    assert {(r[1], r[2]) for r in gotten(clusters(same))} == {(0, 0)}


def test_odd_rows(spark):
    good = [0.25] * 64
    rows = [(1, None, 0), (2, [], 0), (3, good[:63], 0), (4, good + [0.1], 0), (5, [*good[:63], None], 0), (6, [*good[:63], float("nan")], 0),
            (7, [*good[:63], float("inf")], 0), (8, [*good[:63], float("-inf")], 0), (9, good, None), (9, good, None), (None, [-0.0001] * 64, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("v", "n", "cluster", "distance", "total", "x"):
        docs = docs.withColumn(name, docs.label)
    got = clusters(docs).collect()
    assert sorted((r.vec_id, r.distance) for r in got if r.vec_id is not None) == [(9, 0), (9, 0)]
    assert [r.cluster for r in got if r.vec_id is None] == [2], "hashes of null come last"
    assert clusters(docs.limit(0)).collect() == []
    assert clusters(docs.filter("vec_id < 9")).collect() == []
    with pytest.raises(Exception, match="64 bits"):
        clusters(spark.createDataFrame([(1, [1e30] * 64, 0)], SCHEMA)).collect()


def test_floor_of_negative_components(spark):
    points = integer_vectors(spark.createDataFrame([(1, [-0.0001, 0.0009, -1.0, 1.0] * 16, 0)], SCHEMA)).first()
    assert np.frombuffer(points.v, "<i4")[:4].tolist() == [-1, 0, -1024, 1024]


@pytest.mark.parametrize("k, leaf", [(1, 2), (2, 1), (7, 1), (60, 2), (200, 8)])
def test_tree_search_is_exact(k, leaf):
    rng = np.random.default_rng(k)
    middles = rng.integers(-2000, 2000, (6, 16))
    centroids = middles[rng.integers(0, 6, k)] + rng.integers(-3, 4, (k, 16))
    centroids[k // 2] = centroids[0]
    vectors = np.concatenate([middles[rng.integers(0, 6, 400)] + rng.integers(-40, 41, (400, 16)), centroids])
    d = ((vectors[:, None, :] - centroids) ** 2).sum(axis=2)
    cluster, distance, looked = nearest(vectors, centroids, build_tree(centroids, leaf))
    assert (cluster == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
    if k >= 60:
        assert looked < len(vectors) * k / 2, "bounds prune"


def test_on_a_line_every_bound_is_tight():
    """Points half way between centroids: the bound of the other side equals the best distance."""
    centroids = np.array([[2 * i] for i in range(50)], np.int64)
    vectors = np.arange(-3, 103, dtype=np.int64)[:, None]
    d = np.abs(vectors - centroids[:, 0]) ** 2
    cluster, distance, _ = nearest(vectors, centroids, build_tree(centroids, 1))
    assert (cluster == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
