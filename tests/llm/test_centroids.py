"""Centroid clustering against a plain loop over all pairs."""

import hashlib
import math
import random

import numpy as np
import pytest

from quillon.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cluster string"


def brute(rows, k, rounds, dimensions, salt=2):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"{salt}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centers = [v for _, v in start[:k]]
    if not centers:
        return []

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centers))

    for _ in range(rounds):
        groups = [[] for _ in centers]
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centers = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, centers)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = {}
    for _, d, n in found:
        inertia[n] = inertia.get(n, 0) + d
    return [(i, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, centers[n])).encode()).hexdigest()) for i, d, n in found]


def same(got, want):
    return sorted(map(repr, got)) == sorted(map(repr, want))


def clustered(spark, rows, k, rounds, dimensions, **options):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA).repartition(3)
    return [tuple(r) for r in centroids.cluster(df, k, rounds, dimensions=dimensions, **options).collect()]


def test_odd_rows(spark):
    ok = [0.5, -0.25, 0.001]
    rows = [(1, ok), (1, ok), (1, [0.0, 0.0, 0.0]), (None, [0.1, 0.2, 0.3]), (2, None), (3, []), (4, [1.0, 2.0]), (5, [1.0, float("nan"), 0.0]), (6, [1.0, float("inf"), 0.0]), (7, [None, 0.0, 0.0]), (8, [-1.0, -1.0, -1.0]), (9, [300.0, -70_000.0, 0.0])]
    for k in (1, 2, 40):
        assert same(clustered(spark, rows, k, 3, 3), brute(rows, k, 3, 3))
    assert clustered(spark, [], 3, 2, 3) == [] and clustered(spark, rows[4:7], 3, 2, 3) == []
    with pytest.raises(Exception, match="beyond"):
        clustered(spark, [(1, [1e7, 0.0, 0.0])], 1, 1, 3)


def test_ties_empty_clusters_and_small_blocks(spark, monkeypatch):
    """Vectors on a small grid, many of them equal, so that distances tie and centroids meet."""
    monkeypatch.setattr(centroids, "BLOCK", 7)
    random.seed(5)
    rows = [(k % 90, [random.randrange(-2, 3) / 256, random.randrange(-2, 3) / 256]) for k in range(200)]
    for k, rounds in ((30, 4), (6, 6)):
        assert same(clustered(spark, rows, k, rounds, 2), brute(rows, k, rounds, 2))


def test_bounds_leave_most_vectors_unscanned(spark):
    random.seed(8)
    rows = [(k, [10 * (k % 5) + random.random(), random.random()]) for k in range(400)]
    counted = []
    assert same(clustered(spark, rows, 5, 5, 2, counted=counted), brute(rows, 5, 5, 2))
    assert counted[0] == 400 and counted[-1] < 100


def test_bounds_are_exact_for_random_moves():
    random.seed(1)
    for size in (3, 1 << 26):
        rng = np.random.default_rng(size % 7)
        vectors = rng.integers(-size, size + 1, (500, 4))
        before = rng.integers(-size, size + 1, (9, 4))
        state = centroids.Bounds(before, None).scan(vectors)
        for _ in range(6):
            after = before + rng.integers(-max(1, size // 20), max(1, size // 20) + 1, before.shape)
            *state, _ = centroids.Bounds(after, before).assign(vectors, *state)
            exact = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(after))[1] for v in vectors]
            assert state[0].tolist() == exact
            before = after


def test_query(spark, data):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert same([tuple(r) for r in centroids.op11_centroids(spark, data).collect()], brute(rows, 40, 5, 64))
