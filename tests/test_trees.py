"""Trees, forests and grids against trees grown by trying every split on the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from staywise.operators import trees as tr

FEATURES = ["a", "b", "c"]


def data(n=2000, seed=0, labels=20):
    rng = np.random.default_rng(seed)
    x = np.c_[rng.integers(0, 12, n), rng.integers(0, 30, n) / 4, rng.integers(0, 3, n)].astype(float)
    y = np.round(np.where(x[:, 0] > 5, 3 * x[:, 2], x[:, 1]) + rng.exponential(2, n)) % labels
    return x, y


def frame(spark, x, y, groups=None):
    groups = np.zeros(len(x), int) if groups is None else groups
    rows = [(i, int(g), *map(float, v), float(t)) for i, (v, t, g) in enumerate(zip(x, y, groups))]
    odd = [(-1, 0, None, 1.0, 1.0, 1.0), (-2, 0, 1.0, float("nan"), 1.0, 1.0), (-3, 0, 1.0, 1.0, 1.0, None)]
    return spark.createDataFrame(rows + odd, "id long, g int, a double, b double, c double, y double").repartition(6)


def middle(y, w):
    """Weighted median: the mean of the two middle rows."""
    y = np.sort(np.repeat(y, w.astype(int)))
    return (y[(len(y) - 1) // 2] + y[len(y) // 2]) / 2


def error(y, w, criterion):
    if not w.sum():
        return 0.0, 0.0
    if criterion == "absolute":
        m = middle(y, w)
        return m, (w * np.abs(y - m)).sum()
    m = (w * y).sum() / w.sum()
    return m, (w * (y - m) ** 2).sum()


def brute(x, y, w, cuts, criterion, depth):
    """value of each row by a recursive search over all splits, and the splits taken."""
    out, splits = np.zeros(len(x)), []

    def split(rows, level, node):
        value, whole = error(y[rows], w[rows], criterion)
        best = (0.0, None)
        if level < depth:
            for f in range(x.shape[1]):
                for b, cut in enumerate(cuts.features[f]):
                    left = x[rows, f] <= cut
                    if w[rows][left].sum() and w[rows][~left].sum():
                        gain = whole - error(y[rows][left], w[rows][left], criterion)[1] - error(y[rows][~left], w[rows][~left], criterion)[1]
                        if gain > best[0] + 1e-7:
                            best = (gain, (f, b, left))
        if best[1] is None:
            out[rows] = value
            return
        f, b, left = best[1]
        splits.append((node, f, b))
        split(rows[left], level + 1, 2 * node + 1)
        split(rows[~left], level + 1, 2 * node + 2)

    split(np.arange(len(x)), 0, 0)
    return out, sorted(splits)


def exact_cuts(x, y):
    return tr.Cuts(tuple(tuple(np.unique(c)[:-1].tolist()) for c in x.T), tuple(np.unique(y)[:-1].tolist()))


@pytest.mark.parametrize("criterion", ["squared", "absolute"])
@pytest.mark.parametrize("seed", [None, 5])
def test_tree_equals_brute_force(spark, criterion, seed):
    x, y = data()
    cuts = exact_cuts(x, y)
    df = frame(spark, x, y)
    rows = tr.binned(df, FEATURES, "y", ["id"], cuts).cache()
    (tree,) = tr.grow(rows, [tr.Model(frozenset({0}), criterion, seed)], cuts, 3)
    hashes = {r["id"]: r["h"] for r in df.select("id", F.xxhash64("id").alias("h")).collect()}
    w = tr.draw(np.array([hashes[i] for i in range(len(x))]), seed)
    assert (w.sum() == len(x)) if seed is None else (abs(w.mean() - 1) < 0.1 and w.min() == 0)
    want, splits = brute(x, y, w, cuts, criterion, 3)
    assert sorted((int(i), int(tree.feature[i]), int(tree.bin[i])) for i in np.flatnonzero(tree.feature >= 0)) == splits
    np.testing.assert_allclose(tree.predict(cuts.bins(x)), want, rtol=1e-9, atol=1e-9)


def test_one_shuffle_per_level(spark, monkeypatch):
    x, y = data(300)
    cuts = exact_cuts(x, y)
    rows = tr.binned(frame(spark, x, y), FEATURES, "y", ["id"], cuts).cache()
    calls = []
    once = tr._splits
    monkeypatch.setattr(tr, "_splits", lambda *a: calls.append(len(a[4])) or once(*a))
    models = [tr.Model(frozenset({0}), c, s) for c in ("squared", "absolute") for s in range(4)]
    whole = tr.grow(rows, models, cuts, 3)
    assert len(calls) == 3 and calls[0] == 8
    monkeypatch.setattr(tr, "CELLS", 5000)  # in lots: the same trees
    for a, b in zip(whole, tr.grow(rows, models, cuts, 3)):
        assert (a.feature == b.feature).all() and (a.bin == b.bin).all() and np.allclose(a.value, b.value)
    assert len(calls) > 6


def test_groups_and_empty_models(spark):
    x, y = data(600, 2)
    groups = np.arange(600) % 3
    cuts = exact_cuts(x, y)
    rows = tr.binned(frame(spark, x, y, groups), FEATURES, "y", ["id"], cuts, F.col("g")).cache()
    models = [tr.Model(frozenset({0, 2})), tr.Model(frozenset({1}), "absolute"), tr.Model(frozenset({7}))]
    a, b, none = tr.grow(rows, models, cuts, 2)
    ones = np.ones(600)
    np.testing.assert_allclose(a.predict(cuts.bins(x))[groups != 1], brute(x[groups != 1], y[groups != 1], ones[groups != 1], cuts, "squared", 2)[0])
    np.testing.assert_allclose(b.predict(cuts.bins(x))[groups == 1], brute(x[groups == 1], y[groups == 1], ones[groups == 1], cuts, "absolute", 2)[0])
    assert (none.feature == -1).all()
    flat = tr.binned(frame(spark, x, np.full(600, 4.0)), FEATURES, "y", ["id"], cuts)
    (tree,) = tr.grow(flat, [tr.Model(frozenset({0}))], cuts, 2)
    assert (tree.feature == -1).all() and tree.predict(cuts.bins(x)).tolist() == [4.0] * 600
    (tree,) = tr.grow(flat.limit(0), [tr.Model(frozenset({0}))], cuts, 2)
    assert (tree.feature == -1).all()


def test_medians_of_levels():
    rng = np.random.default_rng(1)
    values = np.sort(rng.choice(100, 9, replace=False)).astype(float)
    for _ in range(50):
        w = rng.integers(0, 4, 9).astype(float)
        if not w.sum():
            continue
        m, e = tr._fractions(w, w * values)
        assert m == middle(values, w) and e == pytest.approx((w * np.abs(values - m)).sum())


def test_cut_points_cover_the_values(spark):
    x, y = data(1000, 3)
    cuts = tr.cut_points(frame(spark, x, y), FEATURES, "y", 8, 16)
    assert [len(c) for c in cuts.features] == [7, 7, 3] and len(cuts.levels) <= 15  # a cut at the largest value splits nothing
    assert tr.cut_points(frame(spark, x, y).limit(0), FEATURES, "y") == tr.Cuts(((), (), ()), ())
    assert cuts.bins(np.array([[cuts.features[0][0], -9, 9]])).tolist() == [[0, 0, 3]]


def test_grid_forest_scores_every_size_and_fold(spark, monkeypatch):
    x, y = data(500, 4)
    df = frame(spark, x, y, np.arange(500) % 3)
    passes = []
    once = tr._splits
    monkeypatch.setattr(tr, "_splits", lambda *a: passes.append(1) or once(*a))
    grid = tr.grid_forest(df, FEATURES, "y", ["id"], F.col("g"), sizes=(1, 2, 4), depth=3)
    assert len(passes) == 3 and len(grid.scores) == 2 * 3 * 3 and sum(s["best"] for s in grid.scores) == 3
    assert sum(s["n_rows"] for s in grid.scores if s["best"]) == 500
    assert len(grid.forest.trees) == grid.best["trees"]
    cuts = tr.cut_points(df, FEATURES, "y")
    rows = tr.binned(df, FEATURES, "y", ["id"], cuts, F.col("g"))
    for criterion in ("squared", "absolute"):
        own = tr.grow(rows, [tr.Model(frozenset({0, 1}), criterion, 2 + t) for t in range(4)], cuts, 3)
        out = np.arange(500) % 3 == 2
        for n in (1, 4):
            p = tr.Forest(tuple(own[:n]), cuts).predict(cuts.bins(x[out]))
            (s,) = [s for s in grid.scores if (s["criterion"], s["trees"], s["fold"]) == (criterion, n, 2)]
            assert s["r2"] == pytest.approx(1 - ((y[out] - p) ** 2).mean() / y[out].var(), rel=1e-9)


def test_strata_and_predictions(spark):
    x, y = data(400, 6)
    df = frame(spark, x, y, np.arange(400) % 2).withColumn("s", F.when(F.col("g") == 0, "even").otherwise("odd"))
    forests = tr.strata_forests(df, FEATURES, "y", ["id"], "s", ["even", "odd"], trees=2, depth=2)
    got = {r["id"]: r for r in tr.with_predictions(df, FEATURES, forests, "s", "p").collect()}
    assert len(got) == 403 and got[-1]["p"] is None and got[-2]["p"] is None and got[-3]["p"] is not None
    for i in range(400):
        want = forests["odd" if i % 2 else "even"]
        assert got[i]["p"] == pytest.approx(want.predict(want.cuts.bins(x[i : i + 1]))[0])
    alone = tr.with_predictions(df, FEATURES, {"": forests["odd"]}).filter("id = 0").first()
    assert alone["prediction"] == pytest.approx(forests["odd"].predict(forests["odd"].cuts.bins(x[:1]))[0])


def test_importances_sum_to_one(spark):
    x, y = data(500, 7)
    cuts = exact_cuts(x, y)
    rows = tr.binned(frame(spark, x, y), FEATURES, "y", ["id"], cuts)
    found = dict(tr.importances(tr.grow(rows, [tr.Model(frozenset({0}), "squared", s) for s in range(3)], cuts, 3), FEATURES))
    assert sum(found.values()) == pytest.approx(1) and min(found.values()) >= 0
    assert tr.importances([tr.Tree(2)], FEATURES) == [(f, 0.0) for f in FEATURES]


def test_value_cuts(spark):
    x, y = data(200)
    assert tr.value_cuts(frame(spark, x, y), FEATURES, "y") == exact_cuts(x, y)
    with pytest.raises(ValueError):
        tr.value_cuts(frame(spark, x, y), FEATURES, "y", 5)


def test_leaves_by_columns():
    rng = np.random.default_rng(12)
    tree, bins = tr.Tree(4), rng.integers(0, 6, (500, 3))
    tree.feature[:15] = rng.integers(-1, 3, 15)
    tree.feature[0], tree.bin[:15], tree.value[:] = 1, rng.integers(0, 6, 15), rng.normal(0, 1, 31)
    want = []
    for row in bins:
        i = 0
        while tree.feature[i] >= 0:
            i = 2 * i + 1 + (row[tree.feature[i]] > tree.bin[i])
        want.append(i)
    assert tree.leaf(bins).tolist() == want and tree.predict(np.asfortranarray(bins)).tolist() == tree.value[want].tolist()
    assert tr.Tree(2).leaf(bins).tolist() == [0] * 500
