"""The metric tree: what it leaves out, and what it must not."""

import numpy as np
import pytest

from staywise.operators import knn, lsh
from tests.conftest import SMALL


def clustered(n, rng, spread=0.05):
    centres = rng.normal(0, 1, (20, 6))
    return centres[rng.integers(0, 20, n)] + rng.normal(0, spread, (n, 6))


def grown(train, pivots, k):
    tree = knn.MetricTree(np.unique(train[:pivots], axis=0))
    leaf, far, far_top = tree.assign(train)
    tree.know(k, [(c, far[leaf == c].max(), far[leaf == c].min(), far_top[leaf == c].max(), np.sort(far[leaf == c])[:k]) for c in np.unique(leaf)])
    return tree, leaf


@pytest.mark.parametrize("kind", ["clustered", "flat", "ties"])
@pytest.mark.parametrize("pivots", [1, 2, 7, 200])
def test_no_neighbour_is_left_out(kind, pivots):
    rng = np.random.default_rng(3)
    make = {"clustered": lambda n: clustered(n, rng), "flat": lambda n: rng.normal(0, 1, (n, 6)), "ties": lambda n: rng.integers(0, 2, (n, 6)).astype(float)}[kind]
    train, test, k = make(500), make(80), 5
    tree, leaf = grown(train, pivots, k)
    rows, leaves = tree.visits(test)
    seen = set(zip(rows.tolist(), leaves.tolist()))
    gaps = ((test[:, None] - train[None]) ** 2).sum(axis=2)
    for i, gap in enumerate(gaps):
        for j in np.flatnonzero(gap <= np.sort(gap)[k - 1]):
            assert (i, leaf[j]) in seen


def test_few_rows_travel_on_clustered_data():
    rng = np.random.default_rng(4)
    both = clustered(6000, rng)
    train, test = both[:5000], both[5000:]
    tree, leaf = grown(train, 400, 5)
    rows, leaves = tree.visits(test)
    size = np.bincount(leaf, minlength=len(tree.pivots))
    compared = size[leaves].sum() / (len(train) * len(test))
    sent = size[np.unique(leaves)].sum()
    assert compared < 0.1 and sent <= len(train)  # one batch: no training row travels twice
    near = tree.visits(test[:5])[1]
    assert size[np.unique(near)].sum() < 0.5 * len(train)  # leaves that no test row visits stay where they are


def test_small_and_repeated_pivots():
    tree, leaf = grown(np.zeros((9, 3)), 4, 2)
    assert len(tree.pivots) == 1 and leaf.tolist() == [0] * 9
    assert tree.visits(np.ones((2, 3)))[1].tolist() == [0, 0]


def vectors(spark, x, labels=None, start=0):
    rows = [(start + i, v.tolist(), float(0 if labels is None else labels[i])) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, v array<double>, y double").repartition(3)


def test_lsh_meets_nine_in_ten_neighbours(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    train, test = df.filter("vec_id % 3 > 0"), df.filter("vec_id % 3 = 0")
    found = lsh.lsh_regress(train, test, "vec_id", "embedding", "label", 5)
    assert found.recall >= 0.9
    a, b = (np.array([r["embedding"] for r in x.orderBy("vec_id").collect()], float) for x in (train, test))
    gaps = ((b[:, None] - a[None]) ** 2).sum(axis=2)
    if found.tables:
        projections = lsh.Projections(64, found.tables, np.cov(a.T, bias=True))
        nearest = [a[np.argsort(g)[:5]] for g in gaps]
        assert lsh.recall(projections, found.probes, b, nearest) >= 0.85  # all rows, cells of another width
    got = {r["vec_id"]: r["prediction"] for r in found.frame.collect()}
    exact = {r["vec_id"]: r["prediction"] for r in knn.knn_regress(train, test, "vec_id", "embedding", "label", 5).collect()}
    assert got.keys() == exact.keys()
    assert np.mean([abs(got[i] - exact[i]) for i in got]) < 0.3


def test_lsh_on_clusters_compares_few_rows(spark):
    rng = np.random.default_rng(6)
    both = clustered(1200, rng, 0.02)
    train, test = both[:1000], both[1000:]
    found = lsh.lsh_regress(vectors(spark, train, train[:, 0]), vectors(spark, test, start=5000), "id", "v", "y", 5)
    assert found.recall >= 0.9 and (found.tables, found.probes) <= (8, 27)
    projections = lsh.Projections(6, found.tables, np.cov(train.T, bias=True))
    asked, held = projections.probes(test, found.probes), projections.buckets(train)
    met = (asked[:, None] == held[None, :, :, None]).any(axis=(2, 3))
    assert met.mean() < 0.5
    got = {r["id"]: r["prediction"] for r in found.frame.collect()}
    assert sorted(got) == list(range(5000, 5200))
    want = [train[np.argsort(((train - t) ** 2).sum(axis=1))[:5], 0].mean() for t in test]
    assert np.mean(np.abs(np.array([got[5000 + i] for i in range(200)]) - want)) < 0.02


def test_lsh_few_rows(spark):
    train, test = vectors(spark, np.eye(3), [1, 2, 6]), vectors(spark, np.eye(3), start=10)
    assert {r["prediction"] for r in lsh.lsh_regress(train, test, "id", "v", "y", 5).frame.collect()} == {3.0}
    assert lsh.lsh_regress(train, test.limit(0), "id", "v", "y").frame.count() == 0
    assert [r["prediction"] for r in lsh.lsh_regress(train.limit(0), test, "id", "v", "y").frame.collect()] == [None] * 3


@pytest.mark.parametrize("kind", ["flat", "ties", "far", "nan"])
def test_nearest_equals_brute_force(kind):
    rng = np.random.default_rng(8)
    train, test = rng.normal(0, 1, (300, 6)), rng.normal(0, 1, (40, 6))
    if kind == "ties":
        train, test = train.round(), test.round()
    if kind == "far":
        train, test = train * 1e-3 + 1e6, test * 1e-3 + 1e6
    if kind == "nan":
        train[::3, 0] = np.nan
    gaps = ((test[:, None] - train[None]) ** 2).sum(axis=2)
    rows, cols, got = knn.nearest(test, train, 5)
    want = np.argsort(gaps, axis=1, kind="stable")[:, :5]
    assert (rows.reshape(-1, 5) == np.arange(40)[:, None]).all() and (cols.reshape(-1, 5) == want).all()
    assert (got.reshape(-1, 5) == np.take_along_axis(gaps, want, axis=1)).all()
    met = rng.random(gaps.shape) < 0.1
    rows, cols, _ = knn.nearest(test, train, 5, met)
    for i in range(40):
        own = np.flatnonzero(met[i])
        assert cols[rows == i].tolist() == own[np.argsort(gaps[i, own], kind="stable")[:5]].tolist()


def test_rows_travel_once_per_branch(spark):
    rng = np.random.default_rng(9)
    train, test = vectors(spark, rng.normal(0, 1, (600, 6))), vectors(spark, rng.normal(0, 1, (50, 6)), start=9000)
    frame = knn.knn_regress(train, test, "id", "v", "y", 5, pivots=64)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    # a test row is sent to the 8 branches at most, not to each of the 64 leaves
    cogroup = next(line for line in plan.splitlines() if "FlatMapCoGroupsInPandas" in line)
    assert "top" in cogroup and "cell#" not in cogroup.split("search")[0]
    assert frame.count() == 50


def lsh_brute(train, test, projections, probes, k):
    """Mean label per test id by the rule: the k nearest ids that share a bucket, a repeated id at its nearest."""
    a, b = (np.array([v for _, v, *_ in side]) for side in (train, test))
    met = (projections.probes(b, probes)[:, None] == projections.buckets(a)[None, :, :, None]).any(axis=(2, 3))
    gaps, out = ((b[:, None] - a[None]) ** 2).sum(axis=2), {}
    for i, (q, _) in enumerate(test):
        best = out.setdefault(q, {})
        for j in np.flatnonzero(met[i]):
            best[train[j][0]] = min(best.get(train[j][0], (np.inf, 0)), (gaps[i, j], train[j][2]))
    return {q: np.mean([y for _, y in sorted(best.values())[:k]]) for q, best in out.items() if len(best) >= k}


def test_lsh_blocks_hold_the_bucket_join(spark, monkeypatch):
    rng = np.random.default_rng(10)
    both = clustered(700, rng, 0.05)
    train = [(i // 2, v, float(i // 2 % 7)) for i, v in enumerate(both[:600])]  # every id twice
    test = [(5000 + i, v) for i, v in enumerate(both[600:])]
    rows = spark.createDataFrame([(i, v.tolist(), y) for i, v, y in train], "id long, v array<double>, y double").repartition(3)
    asks = spark.createDataFrame([(i, v.tolist()) for i, v in test], "id long, v array<double>").repartition(2)
    monkeypatch.setattr(lsh, "BLOCK_ROWS", 64)
    made = []
    once = lsh.Projections
    monkeypatch.setattr(lsh, "Projections", lambda *a, **k: made.append(once(*a, **k)) or made[-1])
    found = lsh.lsh_regress(rows, asks, "id", "v", "y", 5)
    # vectors meet in blocks: none is copied per probe, no pair of rows is shuffled
    assert "bucket" not in found.frame._jdf.queryExecution().optimizedPlan().toString()
    want = lsh_brute(train, test, made[-1], found.probes, 5)
    got = {r["id"]: r["prediction"] for r in found.frame.collect()}
    assert len(want) > 50 and all(got[q] == pytest.approx(want[q], rel=1e-12) for q in want) and len(got) == 100


def test_probes_start_at_home_and_are_different():
    rng = np.random.default_rng(1)
    projections = lsh.Projections(6, 4, np.eye(6))
    x = rng.normal(0, 1, (50, 6))
    asked = projections.probes(x, 27)
    assert (asked[:, :, 0] == projections.buckets(x)).all()
    assert all(len(set(keys.tolist())) == 27 for row in asked for keys in row)
