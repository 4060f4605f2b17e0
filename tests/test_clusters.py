"""Silhouettes and simultaneous k-means against plain loops over all pairs of rows."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from staywise.operators import clusters as cl
from workload import QUERIES


def brute(x, own):
    gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for i in range(len(x)):
        same = own == own[i]
        others = [gap[i, own == c].mean() for c in np.unique(own) if c != own[i]]
        if same.sum() == 1 or not others:
            out.append(0.0)
            continue
        a, b = gap[i, same].sum() / (same.sum() - 1), min(others)
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(out))


def frame(spark, x, own):
    return spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, own))], "id long, x array<double>, c int").repartition(4)


def measured(df, clusters, anchors=cl.ANCHORS):
    return cl.silhouette_of(df, F.col("x"), F.col("c"), ["id"], clusters, anchors)


@pytest.mark.parametrize("case", ["groups", "one row alone", "one cluster", "copies"])
def test_silhouette_is_exact_while_clusters_are_small(spark, case):
    rng = np.random.default_rng(5)
    own = rng.integers(0, 3, 150)
    x = rng.normal(0, 1, (150, 4)) + own[:, None]
    if case == "one row alone":
        own[0] = 3
    if case == "one cluster":
        own[:] = 0
    if case == "copies":
        x[:] = x[0]
    got = measured(frame(spark, x, own), 4)
    assert got.n_rows == 150 and got.error == 0.0
    assert got.score == pytest.approx(brute(x, own), rel=1e-9, abs=1e-12)


def test_anchors_estimate_within_their_error(spark):
    rng = np.random.default_rng(6)
    own = (rng.random(900) < 0.7).astype(int)
    x = rng.normal(0, 1, (900, 3)) + own[:, None]
    got, want = measured(frame(spark, x, own), 2, 100), brute(x, own)
    assert 0 < got.error < 0.1 and abs(got.score - want) < 4 * got.error


@pytest.mark.parametrize("rows", [7, 40, 1000])
@pytest.mark.parametrize("case", ["groups", "one row alone", "one cluster", "copies", "many clusters", "numbers of any kind", "whole rows twice"])
def test_all_pairs_count_without_anchors(spark, monkeypatch, case, rows):
    monkeypatch.setattr(cl, "BLOCK_VALUES", rows * 4)
    monkeypatch.setattr(cl, "PAIRS", 64)
    rng = np.random.default_rng(12)
    own = rng.integers(0, 60 if case == "many clusters" else 3, 150)
    x = rng.normal(0, 1, (150, 4)) + own[:, None]
    if case == "one row alone":
        own[0] = 3
    if case == "one cluster":
        own[:] = 0
    if case == "copies":
        x[:] = x[0]
    if case == "numbers of any kind":
        own = np.array([-5, 7, 100_000])[own]
    df = frame(spark, x, own)
    if case == "whole rows twice":
        x, own, df = np.r_[x, x], np.r_[own, own], df.union(df)
    got = measured(df, None, None)
    assert got.n_rows == len(x) and got.error == 0.0
    assert got.score == pytest.approx(brute(x, own), rel=1e-9, abs=1e-12)


def test_small_blocks_are_joined_before_they_meet(spark, monkeypatch):
    rng = np.random.default_rng(15)
    own = rng.integers(0, 3, 150)
    x = rng.normal(0, 1, (150, 4)) + own[:, None]
    monkeypatch.setattr(cl, "BLOCK_VALUES", 60 * 4)
    df, tasks = frame(spark, x, own), []
    ranged, dealt = type(df).repartitionByRange, type(df).repartitionById
    monkeypatch.setattr(type(df), "repartitionByRange", lambda self, n, *by: ranged(self, 37, *by))
    monkeypatch.setattr(type(df), "repartitionById", lambda self, n, by: tasks.append(n) or dealt(self, n, by))
    assert measured(df, None, None).score == pytest.approx(brute(x, own), rel=1e-9)
    assert max(tasks) <= 5 * 6 // 2  # 37 blocks would be 703 pairs


def test_all_pairs_rows_without_cluster_or_vector_count_zero(spark):
    rng = np.random.default_rng(13)
    own = rng.integers(0, 3, 60)
    x = rng.normal(0, 1, (60, 2)) + own[:, None]
    odd = spark.createDataFrame([(100, [1.0, 1.0], None), (101, None, 1), (102, None, None)], "id long, x array<double>, c int")
    got = measured(frame(spark, x, own).union(odd), None, None)
    assert got.n_rows == 63 and got.score == pytest.approx(brute(x, own) * 60 / 63, rel=1e-9)
    assert measured(odd, None, None) == cl.Silhouette(0.0, 0.0, 3)
    assert measured(odd.limit(0), None, None) == cl.Silhouette(None, 0.0, 0)


def test_silhouette_by_label_measures_every_pair(spark, tmp_path):
    """More rows in a label than any anchors: on a line the exact sums come from the sorted values."""
    rng = np.random.default_rng(14)
    own = np.repeat([0, 1], [11_000, 10_500])
    x = (rng.normal(0, 1, len(own)) + own).astype("float32")
    pd.DataFrame({"vec_id": np.arange(len(own)), "embedding": [[v] for v in x], "label": own.astype("int32")}).to_parquet(tmp_path / "embeddings.parquet")

    def sums(to):
        to = np.sort(to.astype(float))
        upto, at = np.r_[0, np.cumsum(to)], np.searchsorted(to, x)
        return x * at - upto[at] + (upto[-1] - upto[at]) - x * (len(to) - at)

    each = np.stack([sums(x[own == c]) for c in (0, 1)], axis=1)
    rows, size = np.arange(len(own)), np.bincount(own)
    a, b = each[rows, own] / (size[own] - 1), each[rows, 1 - own] / size[1 - own]
    (got,) = QUERIES["silhouette_by_label"](spark, str(tmp_path)).collect()
    assert got["n_rows"] == len(own) and got["silhouette"] == pytest.approx(np.mean((b - a) / np.maximum(a, b)), abs=6e-7)


def test_memory_follows_the_pairs_not_the_columns():
    rng = np.random.default_rng(8)
    x, anchors = rng.normal(0, 1, (100, 64)), rng.normal(0, 1, (2000, 64))
    tracemalloc.start()
    score, _ = cl._silhouettes(x, np.zeros(100, int), np.zeros(100, bool), [anchors, anchors + 1], np.array([2000, 2000]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6  # 100 x 2000 pairs x 64 columns are 102 MB
    a, b = (np.sqrt(((x[:, None] - c[None]) ** 2).sum(axis=2)).mean(axis=1) for c in (anchors, anchors + 1))
    np.testing.assert_allclose(score, (b - a) / np.maximum(a, b), rtol=1e-10)


def test_distances_of_copies_are_zero():
    x = np.random.default_rng(9).normal(1000, 1, (50, 8))
    got = cl._distances(x, np.r_[x, x[:5] + 1e-6])
    want = np.sqrt(((x[:, None] - np.r_[x, x[:5] + 1e-6][None]) ** 2).sum(axis=2))
    np.testing.assert_allclose(got, want, rtol=1e-6)
    assert (np.diag(got) == 0).all()


def test_no_rows(spark):
    assert measured(frame(spark, np.zeros((1, 2)), [0]).limit(0), 2) == cl.Silhouette(None, 0.0, 0)


def reference(x, k, start, rounds=50):
    centres = x[start]
    for _ in range(rounds):
        near = cl.nearest_centre(x, centres)
        centres = np.array([x[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(k)])
    return centres, near


def test_selection_tries_every_column_in_shared_passes(spark, monkeypatch):
    rng = np.random.default_rng(7)
    group = rng.integers(0, 2, 200)
    names = ["a", "b", "c", "d"]
    values = np.c_[rng.normal(0, 1, 200), rng.normal(0, 1, 200) + 6 * group, rng.normal(0, 1, 200), rng.normal(0, 1, 200) + 2 * group]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(values)] + [(999, None, 1.0, 1.0, 1.0)], "id long, a double, b double, c double, d double").repartition(3)
    calls = []
    for name in ("lloyd", "silhouettes"):
        once = getattr(cl, name)
        monkeypatch.setattr(cl, name, lambda *a, once=once, name=name: calls.append(name) or once(*a))
    got = cl.select_by_silhouette(df, names, "a", 3, ["id"], rounds=50)
    assert calls == ["lloyd", "silhouettes"] * 2
    z = (values - values.mean(axis=0)) / values.std(axis=0)
    rank = {r["id"]: r["u"] for r in df.select("id", cl.hash_unit("anchor", "id").alias("u")).collect()}
    start = sorted(range(200), key=lambda i: rank[i])[:2]
    chosen = [0]
    for name, score, error in got[1:]:
        scores = {}
        for i in set(range(4)) - set(chosen):
            own = z[:, [*chosen, i]]
            scores[i] = brute(own, reference(own, 2, start)[1])
        best = max(scores, key=scores.get)
        assert names[best] == name and score == pytest.approx(scores[best], rel=1e-9) and error == 0.0
        chosen.append(best)
    assert got[0] == ("a", None, 0.0) and got[1][0] == "b"
