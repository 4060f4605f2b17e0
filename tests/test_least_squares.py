"""Moments, lines and fold grids against NumPy on the rows themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from staywise.operators import least_squares as ls

COLUMNS = ["a", "b", "c", "y"]
FEATURES, LABEL = COLUMNS[:3], "y"


def data(n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal([1e4, -3, 0.5], [2, 1, 0.1], (n, 3))
    y = x @ [0.5, -2, 7] + rng.normal(0, 1, n) + 100
    return np.c_[x, y], rng.integers(0, 4, n)


def frame(spark, values, groups):
    rows = [(int(g), *map(float, v)) for g, v in zip(groups, values)]
    # rows that must not count: NULL or NaN in any column, one group of nothing else
    rows += [(0, None, 1.0, 1.0, 1.0), (1, 1.0, float("nan"), 1.0, 1.0), (9, 1.0, 1.0, 1.0, None)]
    return spark.createDataFrame(rows, "g int, a double, b double, c double, y double").repartition(5)


@pytest.fixture(params=["native", "wide"])
def form(request, monkeypatch):
    if request.param == "wide":
        monkeypatch.setattr(ls, "MOST_NATIVE", 0)


def test_moments(spark, form):
    values, groups = data()
    got = ls.moments(frame(spark, values, groups), COLUMNS, ["g"])
    assert set(got) == {(0,), (1,), (2,), (3,), (9,)} and got[9,].n == 0 and got[9,].skipped == 1
    for g in range(4):
        own = values[groups == g]
        assert got[g,].n == len(own) and got[g,].skipped == (g < 2)
        np.testing.assert_allclose(got[g,].mean, own.mean(axis=0), rtol=1e-12)
        np.testing.assert_allclose(got[g,].spread, np.cov(own.T, bias=True) * len(own), rtol=1e-7, atol=1e-6)
    whole, alone = ls.total(list(got.values())), ls.moments(frame(spark, values, groups), COLUMNS)[()]
    assert whole.n == alone.n == len(values) and whole.skipped == alone.skipped == 3
    np.testing.assert_allclose(whole.spread, alone.spread, rtol=1e-7, atol=1e-6)


def test_empty(spark, form):
    df = frame(spark, *data()).limit(0)
    assert ls.moments(df, COLUMNS, ["g"]) == {}
    assert sum(m.n for m in ls.moments(df, COLUMNS).values()) == 0


def moments_of(values):
    mean = values.mean(axis=0)
    return ls.Moments(len(values), 0, mean, (values - mean).T @ (values - mean))


@pytest.mark.parametrize("intercept", [True, False])
@pytest.mark.parametrize("normalise,ridge", [(False, 0.0), (True, 0.0), (False, 3.0), (True, 0.2)])
def test_lines(intercept, normalise, ridge):
    values, _ = data(200, 3)
    values[:, 0] -= 1e4
    x, y = values[:, :3], values[:, 3]
    line = ls.solve(moments_of(values), intercept, normalise, ridge)
    z = x - x.mean(axis=0) if intercept else x
    weight = (z**2).sum(axis=0) if normalise and intercept else np.ones(3)
    want = np.linalg.solve(z.T @ z + ridge * np.diag(weight), z.T @ (y - y.mean() if intercept else y))
    np.testing.assert_allclose(line.coefficients, want, rtol=1e-8)
    error = y - line.intercept - x @ np.array(line.coefficients)
    assert ls.squared_error(moments_of(values), line) == pytest.approx((error**2).sum(), rel=1e-9)
    assert ls.r_squared(moments_of(values), line) == pytest.approx(1 - (error**2).mean() / y.var(), rel=1e-9)


def test_dependent_and_constant_features():
    values, _ = data(100, 4)
    full = np.c_[values[:, :3], values[:, 1] * 2, np.full(len(values), 5.0), values[:, 3]]
    line = ls.solve(moments_of(full))
    x, y = full[:, :-1], full[:, -1]
    want = np.linalg.lstsq(np.c_[np.ones(len(x)), x], y, rcond=None)[0]
    np.testing.assert_allclose(line.intercept + x @ np.array(line.coefficients), np.c_[np.ones(len(x)), x] @ want, rtol=1e-6)
    assert ls.solve(ls.Moments(0, 3, np.zeros(2), np.zeros((2, 2)))) is None
    one = ls.solve(moments_of(values[:1]))
    assert one.intercept == pytest.approx(values[0, 3]) and one.coefficients == (0.0, 0.0, 0.0)


def test_grid_scores_every_fold_in_one_pass(spark, monkeypatch):
    values, groups = data(300, 7)
    calls = []
    once = ls.moments
    monkeypatch.setattr(ls, "moments", lambda *a: calls.append(1) or once(*a))
    df = frame(spark, values, groups % 3).filter("g < 3")
    grid = ls.grid_least_squares(df, FEATURES, LABEL, F.col("g"), ridges=(0.0, 5.0))
    assert len(calls) == 1 and grid.skipped == 2 and len(grid.scores) == 2 * 2 * 2 * 3
    folds = groups % 3
    for s in grid.scores:
        if s["ridge"] == 0.0:
            out = values[folds == s["fold"]]
            rest = values[folds != s["fold"]]
            ones = lambda v: np.c_[np.ones(len(v)), v[:, :3]] if s["intercept"] else v[:, :3]  # noqa: E731,B023
            b = np.linalg.lstsq(ones(rest), rest[:, 3], rcond=None)[0]
            assert s["n_rows"] == len(out)
            assert s["r2"] == pytest.approx(1 - ((out[:, 3] - ones(out) @ b) ** 2).mean() / out[:, 3].var(), rel=1e-6)
    means = {(s["intercept"], s["normalise"], s["ridge"]): s["mean_r2"] for s in grid.scores}
    assert means[tuple(grid.best.values())] == pytest.approx(max(means.values()), rel=1e-9)
    assert sum(s["best"] for s in grid.scores) == 3
    with pytest.raises(ValueError):
        ls.grid_least_squares(df, FEATURES, LABEL, F.lit(0))


def test_strata_cover_all_rows(spark):
    values, groups = data(300, 8)
    names = ["x", "y", None, "rare"]
    rows = [(names[g] if i % 50 else "one of a kind", *map(float, v)) for i, (g, v) in enumerate(zip(groups, values))]
    df = spark.createDataFrame(rows, "s string, a double, b double, c double, y double")
    top = ls.strata(df, "s", 2)
    assert len(top) == 2 and set(top) <= {"x", "y", "rare"}
    marked = df.withColumn("stratum", ls.stratum("s", top))
    lines, whole, parts = ls.strata_lines(marked, FEATURES, LABEL, "stratum")
    assert set(lines) == {*top, ls.OTHER} and sum(m.n for m in parts.values()) == len(rows)
    got = ls.with_lines(marked, "stratum", lines, FEATURES, "p").collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {*marked.columns, "p"}
    for r in got:
        line = lines[r["stratum"]]
        assert r["p"] == pytest.approx(line.intercept + sum(b * r[f] for b, f in zip(line.coefficients, FEATURES)), rel=1e-9)
    assert {r["stratum"] for r in df.withColumn("stratum", ls.stratum("s", [])).collect()} == {ls.OTHER}
