"""Support vector regression: epsilon-insensitive loss, linear or with a Gaussian kernel by random features.

Minimises ``|w|^2 / 2 + C * sum(max(0, |y - w z - b| - epsilon))``, the intercept b unpenalised. The loss is
``(|r - epsilon| + |r + epsilon|) / 2 - epsilon``; each absolute value lies below a parabola that touches it at the
present error, so a step is a weighted least squares fit and the objective never rises. One pass over the rows gives
the weighted products of all models of all folds and costs at once, with their objective; the systems, one row per
feature, are solved where the job is driven. Errors within ``SMOOTH`` standard deviations of a kink count as that far
from it, which bounds the weights and moves the objective by less than half of that per row.

The Gaussian kernel ``exp(-gamma * |a - b|^2)`` is the expectation of products of random cosines; ``fourier_map``
draws them from a seed and states them as column expressions. Features are standardised by the training rows.
Rows with a NULL or NaN feature or label are left out.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from staywise.operators.least_squares import _complete, moments

SMOOTH = 1e-3
BLOCK = 1 << 14  # rows of one group that are packed together
LOT = 512  # rows whose weighted products are made at once
STEPS, CLOSE = 60, 1e-4  # passes at most; fewer once no model's objective falls by this share


def standardised(features: Sequence[str], mean: Sequence[float], std: Sequence[float]) -> list[Column]:
    return [(F.col(f).cast("double") - F.lit(float(m))) / F.lit(float(s) if s > 0 else 1.0) for f, m, s in zip(features, mean, std)]


def fourier_draw(columns: int, gamma: float, size: int, seed: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies (cosine, column) and phases of ``size`` random cosines."""
    rng = np.random.default_rng(seed)
    return rng.normal(0, sqrt(2 * gamma), (size, columns)), rng.uniform(0, 2 * pi, size)


def fourier_map(columns: Sequence[Column], gamma: float, size: int, seed: int = 2) -> list[Column]:
    """``size`` random cosines whose products approach the Gaussian kernel."""
    frequency, phase = fourier_draw(len(columns), gamma, size, seed)
    out = []
    for w, p in zip(frequency.tolist(), phase.tolist()):
        angle = F.lit(p)
        for c, v in zip(columns, w):
            angle = angle + c * F.lit(v)
        out.append(F.cos(angle) * F.lit(sqrt(2 / size)))
    return out


@dataclass(frozen=True)
class Machine:
    """Weights and intercept over the mapped features, and the objective after each pass."""

    cost: float
    weights: np.ndarray
    trace: tuple[float, ...]

    def column(self, mapped: Sequence[Column]) -> Column:
        out = F.lit(float(self.weights[0]))
        for c, w in zip(mapped, self.weights[1:].tolist()):
            out = out + c * F.lit(w)
        return out


#: Frequencies and phases of random cosines, see :func:`fourier_draw`; None leaves the features as they are.
Cosines = tuple[np.ndarray, np.ndarray] | None


def packed(rows: DataFrame) -> DataFrame:
    """(g, n, z, y) blocks of rows (g, z, y): ``n`` rows of one group, their features and targets as bytes."""

    def block(g: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        z, y = (np.concatenate(a) for a in zip(*parts))
        out = [pa.array([g], pa.int32()), pa.array([len(y)], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in (z, y)]]
        return pa.RecordBatch.from_arrays(out, names=["g", "n", "z", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            z = batch.column("z").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            g, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("g", "y"))
            for group in np.unique(g).tolist():
                own = np.flatnonzero(g == group)
                if sum(len(p[1]) for p in held.get(group, [])) + len(own) > BLOCK and group in held:
                    yield block(group, held.pop(group))
                held.setdefault(group, []).append((z[own], y[own]))
        for group, parts in held.items():
            yield block(group, parts)

    return rows.select("g", "z", "y").mapInArrow(run, "g int, n int, z binary, y binary")


def _lots(batches: Iterator[pa.RecordBatch], cosines: Cosines) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(group, features behind a column of ones, targets) of a few rows at a time."""
    for batch in batches:
        for g, n, z, y in zip(*(batch.column(c) for c in ("g", "n", "z", "y"))):
            z, y = (np.frombuffer(c.as_buffer(), np.float64) for c in (z, y))
            z = z.reshape(n.as_py(), -1)
            for i in range(0, len(y), LOT):
                x = z[i : i + LOT]
                if cosines is not None:
                    frequency, phase = cosines
                    x = np.cos(x @ frequency.T + phase) * sqrt(2 / len(phase))
                yield g.as_py(), np.c_[np.ones(len(x)), x], y[i : i + LOT]


def _sums(batches: Iterator[pa.RecordBatch], weights: np.ndarray, groups: Sequence[frozenset[int]], epsilon: float, smooth: float, cosines: Cosines = None) -> Iterator[pa.RecordBatch]:
    """Per model the products of the weighted rows, those with the targets, and the sum of the losses."""
    models, k = weights.shape
    products, targets, losses = np.zeros((models, k, k)), np.zeros((models, k)), np.zeros(models)
    own = {}
    for g, x, t in _lots(batches, cosines):
        if g not in own:
            own[g] = np.array([m for m in range(models) if g in groups[m]], int)
        mine = own[g]
        if not len(mine):
            continue
        r = t - weights[mine] @ x.T
        losses[mine] += np.maximum(np.abs(r) - epsilon, 0).sum(axis=1)
        a, b = 1 / np.maximum(np.abs(r - epsilon), smooth), 1 / np.maximum(np.abs(r + epsilon), smooth)
        # the products of all models from one product of matrices
        weighted = x.T * ((a + b) / 2)[:, None, :]
        products[mine] += (weighted.reshape(-1, len(t)) @ x).reshape(len(mine), k, k)
        targets[mine] += (((a + b) * t - epsilon * (a - b)) / 2) @ x
    flat = np.concatenate([products.reshape(models, -1), targets, losses[:, None]], axis=1)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(models)), pa.array([row.tobytes() for row in flat], pa.binary())], names=["m", "v"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One model's sums over the tasks, each task's numbers in one value."""
    m, total = None, 0.0
    for batch in batches:
        for m, v in zip(batch.column("m"), batch.column("v")):
            total = total + np.frombuffer(v.as_buffer())
    yield pa.RecordBatch.from_arrays([pa.array([m.as_py()]), pa.array([total.tobytes()], pa.binary())], names=["m", "v"])


def fit_machines(rows: DataFrame, models: Sequence[tuple[float, frozenset[int]]], features: int, epsilon: float, spread: float) -> list[Machine]:
    """One machine per (cost, groups of rows) over rows (g, z, y); ``spread`` is the label's standard deviation."""
    blocks = packed(rows).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _fit(blocks, models, features, epsilon, spread)
    finally:
        blocks.unpersist()


def _fit(blocks: DataFrame, models: Sequence[tuple[float, frozenset[int]]], features: int, epsilon: float, spread: float, cosines: Cosines = None) -> list[Machine]:
    """The machines over packed rows, their features mapped in the passes: what is kept does not grow with the map."""
    k = features + 1
    weights = np.zeros((len(models), k))
    traces: list[list[float]] = [[] for _ in models]
    best = [(np.inf, weights[m].copy()) for m in range(len(models))]
    smooth = max(SMOOTH * spread, 1e-12)
    penalty = np.diag(np.r_[0.0, np.ones(features)])
    for _ in range(STEPS):
        now = weights.copy()
        parts = blocks.mapInArrow(lambda b: _sums(b, now, [g for _, g in models], epsilon, smooth, cosines), "m long, v binary")  # noqa: B023
        sums = np.zeros((len(models), k * k + k + 1))
        for r in parts.groupBy("m").applyInArrow(_added, "m long, v binary").collect():
            sums[r["m"]] = np.frombuffer(r["v"])
        falls = False
        for m, (cost, _) in enumerate(models):
            value = float(now[m, 1:] @ now[m, 1:] / 2 + cost * sums[m, -1])
            falls |= not traces[m] or value < traces[m][-1] * (1 - CLOSE)
            traces[m].append(value)
            if value < best[m][0]:
                best[m] = value, now[m].copy()
            a, b = sums[m, : k * k].reshape(k, k), sums[m, k * k : -1]
            weights[m] = np.linalg.lstsq(penalty / cost + a, b, rcond=1e-13)[0]
        if not falls:
            break
    return [Machine(cost, w, tuple(t)) for (cost, _), (_, w), t in zip(models, best, traces)]


@dataclass(frozen=True)
class MachineGrid:
    """R2 of every kernel and cost on every fold, the winner, and its prediction as an expression."""

    scores: list[dict]
    best: dict
    prediction: Column
    trace: tuple[float, ...]

    def frame(self, df: DataFrame, places: int = 6) -> DataFrame:
        rows = [(s["kernel"], s["gamma"], s["cost"], s["fold"], s["n_rows"], s["r2"], s["mean_r2"], int(s["best"])) for s in self.scores]
        kind = "kernel string, gamma double, cost double, fold int, n_rows long, r2 double, mean_r2 double, best int"
        return df.sparkSession.createDataFrame(rows, kind).withColumns({c: F.bround(c, places) for c in ("r2", "mean_r2")})


def grid_svr(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    fold: Column,
    folds: int = 3,
    costs: Sequence[float] = (0.01, 1.0, 100.0),
    gammas: Sequence[float] = (0.01, 0.1),
    epsilon: float = 0.1,
    size: int = 50,
    seed: int = 2,
) -> MachineGrid:
    """Cross-validated machines (R3): linear, and Gaussian for every gamma; all costs and folds of a kernel share passes."""
    whole = moments(train, [*features, label])[()]
    std = np.sqrt(np.diag(whole.spread) / max(whole.n, 1))
    z = standardised(features, whole.mean, std)
    complete = train.filter(_complete([*features, label]))
    everything = frozenset(range(folds))
    models = [(c, everything - {f}) for c in costs for f in range(folds + 1)]
    scores, fitted, trained = [], {}, []
    rows = complete.select(fold.cast("int").alias("g"), F.array(*z).alias("z"), F.col(label).cast("double").alias("y"))
    blocks = packed(rows).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for kernel, gamma in [("linear", None), *[("rbf", float(g)) for g in gammas]]:
            cosines = None if gamma is None else fourier_draw(len(z), gamma, size, seed)
            machines = _fit(blocks, models, len(z) if gamma is None else size, epsilon, float(std[-1]), cosines)
            trained.append((kernel, gamma, machines, _errors(blocks, machines, folds, cosines)))
    finally:
        blocks.unpersist()
    for kernel, gamma, machines, added in trained:
        mapped = z if gamma is None else fourier_map(z, gamma, size, seed)
        for i, cost in enumerate(costs):
            fitted[kernel, gamma, cost] = machines[i * (folds + 1) + folds], mapped
            own = []
            for f in range(folds):
                n, s, q, e = added.get(i * (folds + 1) + f, (0, 0, 0, 0))
                spread = q - s * s / n if n else 0
                own.append({"kernel": kernel, "gamma": gamma, "cost": float(cost), "fold": f, "n_rows": int(n), "r2": 1 - e / spread if spread > 0 else None})
            known = [s["r2"] for s in own if s["r2"] is not None]
            scores += [{**s, "mean_r2": sum(known) / len(known) if known else None} for s in own]
    kinds = list(fitted)
    means = {(s["kernel"], s["gamma"], s["cost"]): s["mean_r2"] for s in scores}
    best = max(kinds, key=lambda k: (round(means[k], 9) if means[k] is not None else -np.inf, -kinds.index(k)))
    for s in scores:
        s["best"] = (s["kernel"], s["gamma"], s["cost"]) == best
    machine, mapped = fitted[best]
    return MachineGrid(scores, dict(zip(("kernel", "gamma", "cost"), best)), machine.column(mapped), machine.trace)


def _errors(blocks: DataFrame, machines: Sequence[Machine], folds: int, cosines: Cosines) -> dict[int, tuple[float, ...]]:
    """Per machine: rows, sum, sum of squares and squared errors of the fold it was not fitted on; one pass."""
    weights = np.array([m.weights for m in machines])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(weights), 4))
        for g, z, t in _lots(batches, cosines):
            for m, w in enumerate(weights):
                if g == m % (folds + 1):
                    sums[m] += [len(t), t.sum(), (t**2).sum(), ((t - z @ w) ** 2).sum()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(weights))), *[pa.array(c) for c in sums.T.copy()]], names=["m", "n", "s", "q", "e"])

    added = blocks.mapInArrow(run, "m long, n double, s double, q double, e double").groupBy("m").agg(*[F.sum(c).alias(c) for c in "nsqe"])
    return {r["m"]: (r["n"], r["s"], r["q"], r["e"]) for r in added.collect() if r["n"]}


# worker functions travel by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
