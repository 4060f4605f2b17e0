"""Centroid clustering against a plain loop in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from staywise.llm import centroids
from staywise.llm.centroids import cluster_vectors, integers, nearest, transformed
from staywise.llm.queries import QUERIES
from tests.conftest import SMALL

SCHEMA = "vec_id long, embedding array<float>, cluster int, row string, v long"
MOST = (1 << 63) - 1


def brute(vectors, dims=64, clusters=16, rounds=3):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept vector."""
    rows = [(k, v) for k, v in vectors if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    draw = sorted((hashlib.sha256(f"1:{'' if k is None else k}".encode()).hexdigest(), v) for k, v in rows)
    centres = [[math.floor(64 * x) for x in v] for _, v in draw[:clusters]]
    whole = [(k, [math.floor(64 * x) for x in v]) for k, v in rows]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centres)) for _, v in whole]

    for _ in range(rounds):
        found = assign()
        for i in range(len(centres)):
            if own := [v for (_, v), (_, c) in zip(whole, found) if c == i]:
                centres[i] = [sum(column) // len(own) for column in zip(*own)]
    found = assign()
    inertia = [sum(min(d, MOST) for d, c in found if c == i) for i in range(len(centres))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(k, c, min(d, MOST), min(inertia[c], MOST), min(sum(inertia), MOST), sha[c]) for (k, _), (d, c) in zip(whole, found)]


def key(row):
    return tuple((v is None, v) for v in row)


def plain(df):
    return sorted((tuple(r) for r in df.select("row.vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=key)


def odd(spark, wide=False):
    rng = random.Random(4)
    draw = lambda: [float(np.float32(rng.gauss(0, 0.3))) for _ in range(64)]
    vectors = [(i, draw()) for i in range(60)]
    vectors += [(100 + i, [0.25 * (j % 3) for j in range(64)]) for i in range(40)]  # copies: ties of every kind
    vectors += [(None, draw()), (None, draw()), (5, draw()), (5, [-0.0] * 64), (7, [1e-30] * 64), (8, [-1e-30] * 64)]
    vectors += [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [None] * 64), (205, [math.nan] + [0.0] * 63), (206, [math.inf] + [0.0] * 63), (207, [0.0] * 63 + [None])]
    if wide:
        vectors += [(300, [float(np.float32(3e38))] * 64), (301, [float(np.float32(-3e38))] + [0.0] * 63), (302, [2.0**18] * 64), (303, [2.0**18 - 1] * 64), (304, [1e9] * 64), (305, [1e9] * 63 + [0.0])]
    return vectors


def frame(spark, vectors):
    return spark.createDataFrame([(k, v, 1, "r", 2) for k, v in vectors], SCHEMA).repartition(5)


def test_given_vectors(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    want = brute([(r["vec_id"], r["embedding"]) for r in df.collect()])
    got = sorted(tuple(r) for r in QUERIES["op11_centroids"](spark, SMALL).collect())
    assert got == sorted(want) and len(got) > 100 and len({r[1] for r in got}) > 4


@pytest.mark.parametrize("wide", [False, True])
def test_odd_vectors(spark, wide):
    vectors = odd(spark, wide)
    df = frame(spark, vectors)
    found = cluster_vectors(df)
    assert found.select("row.*").columns == df.columns
    assert plain(found) == sorted(brute(vectors), key=key)


def test_few_and_no_vectors(spark):
    vectors = odd(spark)[:5]
    assert plain(cluster_vectors(frame(spark, vectors))) == sorted(brute(vectors), key=key)
    for df in (frame(spark, vectors).limit(0), frame(spark, [(1, None), (2, [1.0])])):
        assert cluster_vectors(df).collect() == []
    small = [(i, [float(i % 3), 1.0]) for i in range(9)]
    assert plain(cluster_vectors(frame(spark, small), dims=2, clusters=3, rounds=0)) == sorted(brute(small, 2, 3, 0), key=key)


def test_transform_keeps_distances():
    rng = np.random.default_rng(2)
    for dims in (1, 2, 8, 64):
        a, b = rng.integers(-1000, 1000, (2, 50, dims))
        assert (((transformed(a) - transformed(b)) ** 2).sum(axis=1) == dims * ((a - b) ** 2).sum(axis=1)).all()
        order = centroids.coarse_first(dims)
        matrix = transformed(np.eye(dims, dtype=np.int64)).T
        changes = (np.diff(matrix, axis=1) != 0).sum(axis=1)
        assert sorted(order.tolist()) == list(range(dims)) and changes.tolist() == list(range(dims))


@pytest.mark.parametrize("kind", [np.int64, object])
def test_search_is_exact(kind):
    rng = np.random.default_rng(3)
    for spread in (1, 5, 1 << 23):
        x, c = rng.integers(-spread, spread + 1, (400, 64)), rng.integers(-spread, spread + 1, (16, 64))
        c[5], c[9] = c[2], x[0]
        x[1:50] = c[rng.integers(0, 16, 49)]
        far = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        cluster, distance = nearest(x.astype(kind), c.astype(kind))
        assert (cluster == far.argmin(axis=1)).all() and (distance == far.min(axis=1)).all()


def test_bad_centroids_leave_early():
    x = np.zeros((10, 64), np.int64)
    c = np.zeros((4, 64), np.int64)
    c[1:] = 1000 * np.arange(1, 4)[:, None]
    assert (nearest(x, c)[0] == 0).all()


def test_integers_floor():
    assert integers(np.array([[0.1, -0.1, -0.0, 1e-30, -1e-30, 3.99 / 64]])).tolist() == [[6, -7, 0, 0, -1, 3]]
    assert integers(np.array([[1e306, -1e306]])).tolist() == [[int(1e306) * 64, -int(1e306) * 64]]
