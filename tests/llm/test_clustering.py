"""Clustering against a plain version that compares every vector with every centroid."""

import hashlib

import numpy as np
import pytest

from tidemark.llm import clustering

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, v string, id int, cluster string"


def plain(rows, clusters, rounds, width, scale=64):
    kept = [(i, [int(np.floor(scale * np.float64(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == width
            and all(x is not None and np.isfinite(x) for x in v)]
    last = "g"  # behind every digest
    hashed = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else last, r[1]))
    centroids = [v for _, v in hashed[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            own = [v for (_, v), k in zip(kept, of) if k == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {n: sum(d for _, k, d in found if k == n) for n in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, n, d, inertia[n], sum(inertia.values()), digest[n]) for i, n, d in found]


def found(spark, rows, clusters, rounds, width):
    df = spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], SCHEMA).repartition(4)
    out = clustering.with_inertia(*clustering.clusters_of(df, clusters, rounds, width))
    assert out.columns == ["cluster", "vec_id", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return [(r["vec_id"], *(r[c] for c in out.columns if c != "vec_id")) for r in out.collect()]


def alike(a, b):
    return sorted(a, key=str) == sorted(b, key=str)


@pytest.mark.parametrize("clusters, rounds, spread", [(16, 3, 1.0), (7, 6, 0.05), (16, 3, 0.02), (1, 2, 1.0), (2, 3, 0.5)])
def test_equals_comparing_with_all(spark, clusters, rounds, spread):
    rng = np.random.default_rng(clusters)
    centres = rng.normal(size=(5, 8))
    base = centres[rng.integers(0, 5, 400)] + spread * rng.normal(size=(400, 8))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base)]
    rows += [(i + 1000, rows[3][1]) for i in range(150)] + rows[:20]  # a hot vector, and repeated rows
    rows += [(2000, None), (2001, [NAN] * 8), (2002, [1.0] * 7 + [None]), (2003, [INF] + [0.0] * 7), (2004, []), (2005, [1.0] * 9)]
    rows += [(None, [0.5] * 8), (7, [-1.0] * 8)]
    assert alike(found(spark, rows, clusters, rounds, 8), plain(rows, clusters, rounds, 8))


def test_ties_and_equal_centroids(spark):
    grid = [(i, [float(i % 3 - 1) / 64, float(i // 3 % 3 - 1) / 64]) for i in range(90)]
    assert alike(found(spark, grid, 12, 4, 2), plain(grid, 12, 4, 2))
    same = [(i, [0.25, -0.25]) for i in range(20)]
    assert alike(found(spark, same, 16, 3, 2), plain(same, 16, 3, 2))


def test_fewer_vectors_than_clusters_and_none(spark):
    three = [(i, [float(i), 0.0]) for i in range(3)]
    assert alike(found(spark, three, 16, 3, 2), plain(three, 16, 3, 2))
    assert found(spark, [(1, None)], 16, 3, 2) == []


def test_a_distance_beyond_a_long_is_an_error(spark):
    with pytest.raises(Exception, match="smaller scale"):
        found(spark, [(1, [3e30, 0.0]), (2, [0.0, 0.0])], 2, 1, 2)


def test_bounds_spare_most_comparisons():
    rng = np.random.default_rng(1)
    x = np.floor(64 * (rng.normal(size=(20, 8))[rng.integers(0, 20, 5000)] + 0.02 * rng.normal(size=(5000, 8)))).astype(np.int64)
    at = clustering.Centroids(x[:16])
    n = len(x)
    state = clustering.assign(x, at, np.zeros(n, np.int32), np.ones(n, np.int32), np.full(n, np.inf), np.full(n, -np.inf))
    squared = ((x[:, None, :] - at.at[None]) ** 2).sum(axis=2)
    assert (state[0] == squared.argmin(axis=1)).all() and state[4] < 0.9 * 16 * n
    moved = clustering.Centroids(at.at + rng.integers(-2, 3, at.at.shape), at.at)
    again = clustering.assign(x, moved, *state[:4])
    squared = ((x[:, None, :] - moved.at[None]) ** 2).sum(axis=2)
    assert (again[0] == squared.argmin(axis=1)).all() and again[4] < 0.5 * 16 * n
    two = np.sort(squared, axis=1)
    assert (again[2] ** 2 >= two[:, 0] * (1 - 1e-6)).all() and (again[3] <= np.sqrt(two[:, 1]) * (1 + 1e-6)).all()
