"""Boosting rounds against rounds made with NumPy on the rows, and exact grouped quantiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from staywise.operators import boosting as bo
from staywise.operators import trees as tr
from tests.test_trees import FEATURES, brute, data, exact_cuts, frame


@pytest.fixture(scope="module")
def sample(spark):
    x, y = data(800, 11, 40)
    y = y + np.random.default_rng(1).normal(0, 0.5, len(y))
    cuts = tr.Cuts(exact_cuts(x, y).features, ())
    rows = tr.binned(frame(spark, x, y, np.arange(800) % 2), FEATURES, "y", ["id"], cuts, F.col("g")).cache()
    return x, y, cuts, rows


def reference(x, y, cuts, loss, rounds, depth, rate):
    """Start value and predictions after every round."""
    start = y.mean() if loss.kind == "ls" else np.quantile(y, loss.share)
    now, out = np.full(len(y), start), []
    for _ in range(rounds):
        error = y - now
        delta = np.quantile(np.abs(error), loss.alpha) if loss.kind == "huber" else np.inf
        leaf, _ = brute(x, loss.gradient(error, delta), np.ones(len(y)), cuts, "squared", depth)
        node = leaves(x, loss.gradient(error, delta), cuts, depth)
        step = np.zeros(len(y))
        for n in np.unique(node):
            own = error[node == n]
            if loss.kind == "ls":
                step[node == n] = own.mean()
            else:
                q = np.quantile(own, loss.share)
                step[node == n] = q + (np.clip(own - q, -delta, delta).mean() if loss.kind == "huber" else 0.0)
        now = now + rate * step
        out.append(now)
    return start, out


def leaves(x, target, cuts, depth):
    """The leaf of each row of the tree that ``brute`` grows."""
    _, splits = brute(x, target, np.ones(len(x)), cuts, "squared", depth)
    at = {node: (f, b) for node, f, b in splits}
    out = np.zeros(len(x), int)
    for i, row in enumerate(x):
        while out[i] in at:
            f, b = at[out[i]]
            out[i] = 2 * out[i] + 1 + (row[f] > cuts.features[f][b])
    return out


@pytest.mark.parametrize("kind", bo.LOSSES)
def test_rounds_equal_brute_force(sample, kind):
    x, y, cuts, rows = sample
    loss = bo.Loss(kind, 0.8)
    model = bo.Boosted(loss, frozenset({0, 1}), 0.3, cuts)
    bo.boost(rows, [model], 2, 2)
    start, want = reference(x, y, cuts, loss, 2, 2, 0.3)
    assert model.start == pytest.approx(start, rel=1e-12)
    for r in (1, 2):
        np.testing.assert_allclose(model.predict(cuts.bins(x), r), want[r - 1], rtol=1e-9)


def test_models_share_passes_and_losses_fall(sample, monkeypatch):
    x, y, cuts, rows = sample
    calls = []
    once = tr._splits
    monkeypatch.setattr(tr, "_splits", lambda *a: calls.append(1) or once(*a))
    models = [bo.Boosted(bo.Loss(k, 0.8), frozenset(g), 0.3, cuts) for k in bo.LOSSES for g in ({0}, {0, 1})]
    bo.boost(rows, models, 4, 2)
    assert len(calls) == 8  # depth times rounds, not times models
    alone = bo.Boosted(bo.Loss("lad", 0.8), frozenset({0}), 0.3, cuts)
    bo.boost(rows, [alone], 4, 2)
    np.testing.assert_allclose(alone.predict(cuts.bins(x)), models[2].predict(cuts.bins(x)), rtol=1e-12)
    trace = bo.loss_trace(rows, models, 4)
    for m, model in enumerate(models):
        own = [v for k, _, v in trace if k == m]
        assert len(own) == 5 and all(b <= a + 1e-12 for a, b in zip(own, own[1:])) and own[-1] < own[0]
        take = np.isin(np.arange(800) % 2, list(model.groups))
        error = y[take] - model.predict(cuts.bins(x[take]))
        assert own[-1] == pytest.approx(model.loss.value(error, model.delta).mean())


@pytest.mark.parametrize("kind", ["ties", "heavy", "normal", "same"])
def test_grouped_quantiles(spark, kind):
    rng = np.random.default_rng(4)
    y = {"ties": rng.integers(0, 4, 3000).astype(float), "heavy": rng.pareto(0.3, 3000) * rng.choice([-1, 1], 3000), "normal": rng.normal(0, 1, 3000), "same": np.full(3000, 2.5)}[kind]
    rows = tr.binned(frame(spark, np.zeros((3000, 3)), y, np.arange(3000) % 5), FEATURES, "y", ["id"], tr.Cuts(((), (), ()), ()), F.col("g")).cache()
    shares = [0.0, 0.25, 0.5, 0.9, 1.0, 0.5]
    got = bo.grouped_quantiles(rows, lambda g, bins, v: iter([(g, v)]), shares)
    assert got[5] is None
    assert got[:5] == pytest.approx([np.quantile(y[i::5], s) for i, s in enumerate(shares[:5])], rel=1e-12)


def test_quantiles_take_few_passes_over_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    y = rng.normal(0, 1, 20_000)
    cuts = tr.Cuts(((), (), ()), ())
    rows = tr.binned(frame(spark, np.zeros((20_000, 3)), y, np.arange(20_000) % 2).coalesce(2), FEATURES, "y", ["id"], cuts, F.col("g")).cache()
    assert rows.count() == 4  # one row per task and group, not per row
    passes = []
    kind = type(rows)
    once = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **k: passes.append(1) or once(self, *a, **k))
    monkeypatch.setattr(bo, "FINISH", 500)
    got = bo.grouped_quantiles(rows, lambda g, bins, v: iter([(g, v)]), [0.5, 0.9], ([-10.0, -10.0], [10.0, 10.0]))
    assert got == pytest.approx([np.quantile(y[0::2], 0.5), np.quantile(y[1::2], 0.9)], rel=1e-12)
    assert len(passes) == 2  # one that counts, one that fetches what is left


def test_grid(spark):
    x, y = data(400, 12)
    df = frame(spark, x, y, np.arange(400) % 3)
    grid = bo.grid_boost(df, FEATURES, "y", ["id"], F.col("g"), rounds=3, depth=2, rate=0.5)
    assert len(grid.scores) == 12 and len(grid.trace) == 16 and grid.frame(df).filter("best = 1").count() == 3
    cuts = tr.cut_points(df, FEATURES, "y")
    rows = tr.binned(df, FEATURES, "y", ["id"], cuts, F.col("g"))
    model = bo.Boosted(bo.Loss("quantile"), frozenset({0, 2}), 0.5, cuts)
    bo.boost(rows, [model], 3, 2)
    out = np.arange(400) % 3 == 1
    (s,) = [s for s in grid.scores if s["loss"] == "quantile" and s["fold"] == 1]
    assert s["n_rows"] == out.sum() and s["r2"] == pytest.approx(1 - ((y[out] - model.predict(cuts.bins(x[out]))) ** 2).mean() / y[out].var())


def test_no_rows(spark):
    df = frame(spark, *data(10)).limit(0)
    cuts = tr.cut_points(df, FEATURES, "y")
    model = bo.Boosted(bo.Loss("lad"), frozenset({0}), 0.1, cuts)
    bo.boost(tr.binned(df, FEATURES, "y", ["id"], cuts), [model], 1, 2)
    assert model.predict(np.zeros((2, 3), int)).tolist() == [0.0, 0.0]
