"""Least squares from moments: every fold, stratum and candidate out of one pass over the rows.

One aggregate gives, per group, the row count, the means and the products about the means of all features and the
label. Groups add up exactly, so the training moments of a fold are the sum of the other folds' moments, and a fitted
line's squared error on a group needs its moments only. All solving happens on matrices of one row per feature.

Rows with a NULL or NaN feature or label enter no moment; they are counted as ``skipped`` (M16).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations_with_replacement, product

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from staywise.functions.codes import hash_unit

MOST_NATIVE = 200  # products up to which one aggregate of expressions is built; more go through Arrow batches
OTHER = "other"


@dataclass(frozen=True)
class Moments:
    """Of one group: rows, rows left out, means, and sums of products about the means; the label comes last."""

    n: int
    skipped: int
    mean: np.ndarray
    spread: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not self.n or not other.n:
            full = self if self.n else other
            return Moments(n, self.skipped + other.skipped, full.mean, full.spread)
        gap = other.mean - self.mean
        mean = self.mean + gap * (other.n / n)
        spread = self.spread + other.spread + np.outer(gap, gap) * (self.n * other.n / n)
        return Moments(n, self.skipped + other.skipped, mean, spread)


def total(parts: Sequence[Moments]) -> Moments:
    return reduce(Moments.__add__, parts)


@dataclass(frozen=True)
class Line:
    """A fitted linear model."""

    intercept: float
    coefficients: tuple[float, ...]

    def column(self, features: Sequence[str]) -> Column:
        """The prediction as one expression."""
        out = F.lit(self.intercept)
        for f, b in zip(features, self.coefficients):
            out = out + F.col(f).cast("double") * F.lit(b)
        return out


def _complete(columns: Sequence[str]) -> Column:
    whole = F.lit(True)
    for c in columns:
        x = F.col(c).cast("double")
        whole = whole & x.isNotNull() & ~F.isnan(x)
    return F.coalesce(whole, F.lit(False))


def moments(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> dict[tuple, Moments]:
    """Moments of ``columns`` per group, from one pass. The caller bounds the number of groups."""
    k = len(columns)
    pairs = list(combinations_with_replacement(range(k), 2))
    if len(pairs) > MOST_NATIVE:
        return _wide_moments(df, columns, by, pairs)
    whole = _complete(columns)
    x = [F.when(whole, F.col(c).cast("double")) for c in columns]
    wide = df.groupBy(*by).agg(
        F.count_if(whole).alias("_n"),
        F.count_if(~whole).alias("_skipped"),
        F.array(*[F.avg(v) for v in x]).alias("_mean"),
        F.array(*[F.covar_pop(x[i], x[j]) for i, j in pairs]).alias("_spread"),
    )
    out = {}
    for row in wide.collect():
        n = row["_n"]
        spread = np.zeros((k, k))
        for (i, j), v in zip(pairs, row["_spread"]):
            spread[i, j] = spread[j, i] = (v or 0.0) * n
        mean = np.array([v if v is not None else 0.0 for v in row["_mean"]])
        out[tuple(row[c] for c in by)] = Moments(n, row["_skipped"], mean, spread)
    return out


def _wide_moments(df: DataFrame, columns: Sequence[str], by: Sequence[str], pairs: Sequence[tuple[int, int]]) -> dict[tuple, Moments]:
    """The same for many columns: each task sums matrices about a common origin, one row per group and product leaves it."""
    k = len(columns)
    whole = _complete(columns)
    # any origin is right; one near the means keeps the sums small
    near = df.filter(whole).limit(1000).agg(*[F.avg(F.col(c).cast("double")).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    origin = np.array([v if v is not None else 0.0 for v in near])
    keys = [f"_k{i}" for i in range(len(by))]
    rows = df.select(
        *[F.col(c).alias(a) for c, a in zip(by, keys)],
        whole.alias("_whole"),
        F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]).alias("_x"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, k)
            ok = batch.column("_whole").to_numpy(zero_copy_only=False)
            names = list(zip(*(batch.column(c).to_pylist() for c in keys))) if keys else [()] * batch.num_rows
            places: dict[tuple, list[int]] = {}
            for i, name in enumerate(names):
                places.setdefault(name, []).append(i)
            for name, at in places.items():
                good = np.array(at)[ok[at]]
                z = x[good] - origin
                sums = np.r_[len(good), len(at) - len(good), z.sum(axis=0), (z.T @ z)[tuple(zip(*pairs))]]
                held[name] = held[name] + sums if name in held else sums
        for name, sums in held.items():
            columns_ = [pa.array([v] * len(sums), type=kinds[i]) for i, v in enumerate(name)]
            out = [*columns_, pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)]
            yield pa.RecordBatch.from_arrays(out, names=[*keys, "_place", "_sum"])

    fields = [rows.schema[c] for c in keys]
    kinds = [to_arrow_type(f.dataType) for f in fields]
    schema = StructType([*fields, StructField("_place", IntegerType()), StructField("_sum", DoubleType())])
    added = rows.mapInArrow(run, schema).groupBy(*keys, "_place").agg(F.sum("_sum").alias("_sum"))
    sums: dict[tuple, np.ndarray] = {}
    for row in added.collect():
        name = tuple(row[c] for c in keys)
        sums.setdefault(name, np.zeros(2 + k + len(pairs)))[row["_place"]] = row["_sum"]
    out = {}
    for name, s in sums.items():
        n, first = int(s[0]), s[2 : 2 + k]
        spread = np.zeros((k, k))
        spread[tuple(zip(*pairs))] = s[2 + k :]
        spread = spread + np.triu(spread, 1).T
        mean = first / n if n else np.zeros(k)
        out[name] = Moments(n, int(s[1]), mean + (origin if n else 0.0), spread - n * np.outer(mean, mean))
    return out


def solve(m: Moments, intercept: bool = True, normalise: bool = False, ridge: float = 0.0) -> Line | None:
    """The line of least squared error plus ``ridge`` times the squared coefficients; None without rows.

    ``normalise`` weighs the penalty by each feature's length about its mean (only with an intercept). Features that
    depend on each other get the smallest coefficients on the scale of the features' lengths.
    """
    if not m.n:
        return None
    full = m.spread if intercept else m.spread + m.n * np.outer(m.mean, m.mean)
    a, b = full[:-1, :-1], full[:-1, -1]
    length = np.sqrt(np.diag(a))
    length = np.where(length > 0, length, 1.0)
    penalty = np.full(len(a), ridge) if normalise and intercept else ridge / length**2
    scaled = a / np.outer(length, length) + np.diag(penalty)
    coefficients = np.linalg.lstsq(scaled, b / length, rcond=1e-12)[0] / length
    start = float(m.mean[-1] - coefficients @ m.mean[:-1]) if intercept else 0.0
    return Line(start, tuple(coefficients.tolist()))


def squared_error(m: Moments, line: Line) -> float:
    """Sum of the squared errors of the line over the group."""
    b = np.array([*line.coefficients, -1.0])
    gap = line.intercept + b @ m.mean
    return max(float(b @ m.spread @ b), 0.0) + m.n * gap * gap


def r_squared(m: Moments, line: Line) -> float | None:
    return float(1 - squared_error(m, line) / m.spread[-1, -1]) if m.n and m.spread[-1, -1] > 0 else None


# --- grids over folds --------------------------------------------------------


@dataclass(frozen=True)
class FoldGrid:
    """Every candidate's score on every fold, the winner, and its line fitted on all rows."""

    scores: list[dict]
    best: Mapping[str, object]
    line: Line
    skipped: int

    def frame(self, df: DataFrame, places: int = 6) -> DataFrame:
        """One row per candidate and fold."""
        rows = [
            (s["fold"], s["intercept"], s["normalise"], s["ridge"], s["n_rows"], s["r2"], s["mean_r2"], int(s["best"])) for s in self.scores
        ]
        kind = "fold int, intercept int, normalise int, ridge double, n_rows long, r2 double, mean_r2 double, best int"
        out = df.sparkSession.createDataFrame(rows, kind)
        return out.withColumns({c: F.bround(c, places) for c in ("r2", "mean_r2")})


def fold_of(seed: str, folds: int, *keys: str) -> Column:
    """Fold 0, 1, ... by a hash of the keys: the same on any partitioning."""
    return F.floor(hash_unit(seed, *keys) * folds).cast("int")


def grid_least_squares(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    fold: Column,
    intercepts: Sequence[bool] = (True, False),
    normalise: Sequence[bool] = (True, False),
    ridges: Sequence[float] = (0.0,),
) -> FoldGrid:
    """Cross-validated grid (R2, E13): one pass over the rows whatever the number of folds and candidates.

    A candidate's score is the mean of its folds' R2; equal scores (to nine digits) go to the candidate listed first.
    Without a penalty ``normalise`` changes no prediction, so its two candidates tie.
    """
    groups = moments(train.withColumn("_fold", fold), [*features, label], ["_fold"])
    parts = {key[0]: m for key, m in sorted(groups.items())}
    if len(parts) < 2:
        raise ValueError("cross-validation needs rows in two folds or more")
    scores, tried = [], []
    for intercept, norm, ridge in product(intercepts, normalise, ridges):
        row = {"intercept": int(intercept), "normalise": int(norm), "ridge": float(ridge)}
        own = []
        for f, m in parts.items():
            line = solve(total([o for g, o in parts.items() if g != f]), intercept, norm, ridge)
            own.append({**row, "fold": f, "n_rows": m.n, "r2": None if line is None else r_squared(m, line)})
        known = [s["r2"] for s in own if s["r2"] is not None]
        mean = sum(known) / len(known) if known else None
        tried.append((mean, row))
        scores += [{**s, "mean_r2": mean} for s in own]
    winner = max(range(len(tried)), key=lambda i: (round(tried[i][0], 9) if tried[i][0] is not None else -np.inf, -i))
    best = tried[winner][1]
    for i, s in enumerate(scores):
        s["best"] = i // len(parts) == winner
    whole = total(list(parts.values()))
    line = solve(whole, bool(best["intercept"]), bool(best["normalise"]), best["ridge"])
    return FoldGrid(scores, best, line, whole.skipped)


# --- strata ------------------------------------------------------------------


def strata(df: DataFrame, column: str, most: int) -> list[str]:
    """The ``most`` most frequent values (ties by value); all others, and NULL, are the stratum ``other``."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("s")).count()
    return [r["s"] for r in counted.orderBy(F.desc("count"), "s").limit(most).collect()]


def stratum(column: str, names: Sequence[str]) -> Column:
    """The stratum of a row: no row is left out."""
    c = F.col(column).cast("string")
    return F.when(c.isin(*names), c).otherwise(F.lit(OTHER)) if names else F.lit(OTHER)


def strata_lines(df: DataFrame, features: Sequence[str], label: str, by: str, **options) -> tuple[dict, Line, dict[str, Moments]]:
    """A line per stratum, the line of all rows, and the strata's moments (R11): one pass whatever the number of strata."""
    parts = {key[0]: m for key, m in moments(df, [*features, label], [by]).items()}
    lines = {s: line for s, m in parts.items() if (line := solve(m, **options)) is not None}
    return lines, solve(total(list(parts.values())), **options) if parts else None, parts


def with_lines(df: DataFrame, by: str, lines: Mapping[str, Line], features: Sequence[str], name: str) -> DataFrame:
    """Add each row's prediction by its stratum's line, NULL where there is none; one small row per stratum is broadcast."""
    cells = [f"_b{i}" for i in range(len(features) + 1)]
    rows = [(s, line.intercept, *line.coefficients) for s, line in lines.items()]
    table = df.sparkSession.createDataFrame(rows, ", ".join(["_s string", *[f"{c} double" for c in cells]]))
    joined = df.join(F.broadcast(table), F.col(by) == F.col("_s"), "left")
    value = F.col(cells[0])
    for f, c in zip(features, cells[1:]):
        value = value + F.col(f).cast("double") * F.col(c)
    return joined.withColumn(name, value).drop("_s", *cells)


# worker functions travel by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
