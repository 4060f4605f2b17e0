"""Support vector machines against the dual problem, solved coordinate by coordinate with NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from staywise.operators import support_vectors as sv

FEATURES = ["a", "b", "c"]


def data(n=250, seed=0, kind="line"):
    rng = np.random.default_rng(seed)
    x = rng.normal([5, -3, 0.5], [2, 1, 0.1], (n, 3))
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    y = z @ [1.5, -2, 0.5] + 3 if kind == "line" else np.sin(2 * z[:, 0]) + z[:, 1] ** 2
    return x, y + rng.laplace(0, 0.3, n)


def frame(spark, x, y):
    rows = [(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    odd = [(-1, None, 1.0, 1.0, 1.0), (-2, 1.0, float("nan"), 1.0, 1.0), (-3, 1.0, 1.0, 1.0, None)]
    return spark.createDataFrame(rows + odd, "id long, a double, b double, c double, y double").repartition(4)


def dual(z, y, cost, epsilon, rounds=500, far=2.0):
    """Largest lower bound found for the objective, the intercept as a hardly penalised weight of a large constant."""
    z = np.c_[np.full(len(z), far), z]
    beta, w, q, rng = np.zeros(len(z)), np.zeros(z.shape[1]), (z**2).sum(axis=1), np.random.default_rng(0)
    for _ in range(rounds):
        for i in rng.permutation(len(z)):
            slope = w @ z[i] - y[i]
            target = beta[i] - slope / q[i]
            new = np.clip(np.sign(target) * max(abs(target) - epsilon / q[i], 0), -cost, cost)
            w += (new - beta[i]) * z[i]
            beta[i] = new
    return y @ beta - epsilon * np.abs(beta).sum() - w @ w / 2


def objective(z, y, machine, epsilon):
    r = y - machine.weights[0] - z @ machine.weights[1:]
    return machine.weights[1:] @ machine.weights[1:] / 2 + machine.cost * np.maximum(np.abs(r) - epsilon, 0).sum()


def rows_of(spark, z, y, groups=None):
    groups = np.zeros(len(y), int) if groups is None else groups
    return spark.createDataFrame([(int(g), v.tolist(), float(t)) for g, v, t in zip(groups, z, y)], "g int, z array<double>, y double").repartition(3).cache()


@pytest.mark.parametrize("epsilon", [0.1, 0.5])
def test_objective_is_within_one_percent_of_the_dual(spark, epsilon):
    x, y = data(150)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    y = y - np.median(y)  # a small intercept, so that its penalty in the dual is small
    costs = (0.01, 1.0)
    machines = sv.fit_machines(rows_of(spark, z, y), [(c, frozenset({0})) for c in costs], 3, epsilon, y.std())
    for machine in machines:
        value = objective(z, y, machine, epsilon)
        assert value == pytest.approx(min(machine.trace), rel=1e-9)
        bound = dual(z, y, machine.cost, epsilon)
        assert bound * 0.99 <= value <= bound * 1.01
        assert all(b <= a * 1.001 for a, b in zip(machine.trace, machine.trace[1:]))


def test_random_features_approach_the_kernel(spark):
    x, _ = data(40)
    df = frame(spark, x, np.zeros(40)).filter("id >= 0").orderBy("id")
    z = np.array([r["z"] for r in df.select("id", F.array(*sv.fourier_map([F.col(c) for c in FEATURES], 0.3, 400, 5)).alias("z")).orderBy("id").collect()])
    kernel = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - kernel).max() < 0.25
    again = df.select("id", F.array(*sv.fourier_map([F.col(c) for c in FEATURES], 0.3, 400, 5)).alias("z")).orderBy("id").first()
    assert again["z"] == z[0].tolist()


def test_grid(spark):
    x, y = data(300, 3, "curve")
    df = frame(spark, x, y)
    grid = sv.grid_svr(df, FEATURES, "y", F.pmod(F.col("id"), F.lit(3)), costs=(0.1, 10.0), gammas=(0.3,), size=60)
    assert len(grid.scores) == 2 * 2 * 3 and sum(s["n_rows"] for s in grid.scores if s["best"]) == 300
    assert grid.best["kernel"] == "rbf"  # a curve that no line follows
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    out = np.arange(300) % 3 == 1
    (machine,) = sv.fit_machines(rows_of(spark, z, y, out.astype(int)), [(10.0, frozenset({0}))], 3, 0.1, y.std())
    (s,) = [s for s in grid.scores if (s["kernel"], s["cost"], s["fold"]) == ("linear", 10.0, 1)]
    p = machine.weights[0] + z[out] @ machine.weights[1:]
    assert s["r2"] == pytest.approx(1 - ((y[out] - p) ** 2).mean() / y[out].var(), abs=2e-3)
    predicted = df.filter("id >= 0").withColumn("p", grid.prediction).select("y", "p").toPandas()
    assert 1 - ((predicted.y - predicted.p) ** 2).mean() / predicted.y.var() > 0.6
    assert grid.frame(df).count() == 12


def test_no_rows_and_flat_labels(spark):
    x, _ = data(30)
    machine, none = sv.fit_machines(rows_of(spark, x, np.full(30, 4.0)), [(1.0, frozenset({0})), (1.0, frozenset({9}))], 3, 0.1, 0.0)
    assert objective(x, np.full(30, 4.0), machine, 0.1) < 1e-6
    assert none.weights.tolist() == [0.0] * 4


def test_passes_read_blocks_and_map_them_like_the_columns(spark, monkeypatch):
    x, y = data(500, 4, "curve")
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    plain = rows_of(spark, z, y, np.arange(500) % 2)
    blocks = sv.packed(plain)
    assert blocks.count() == 3 * 2  # a row per task and group
    columns = [F.col("z")[i] for i in range(3)]
    mapped = plain.select("g", F.array(*sv.fourier_map(columns, 0.3, 20)).alias("z"), "y").cache()
    models = [(1.0, frozenset({0})), (10.0, frozenset({0, 1}))]
    want = sv.fit_machines(mapped, models, 20, 0.1, y.std())
    monkeypatch.setattr(sv, "LOT", 64)
    got = sv._fit(blocks, models, 20, 0.1, y.std(), sv.fourier_draw(3, 0.3, 20))
    for a, b in zip(got, want):
        np.testing.assert_allclose(a.trace, b.trace, rtol=1e-9)
