"""Scaling fitted on the training rows, as plain column expressions (M3-M5)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fitted(train: DataFrame, aggregates: Sequence[Column]) -> Column:
    """One-row fit as a scalar struct, so applying it needs no join."""
    return train.agg(*aggregates).select(F.struct("*").alias("fit")).scalar()


def scale_minmax(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns mapped by the training range to [0, 1]; a constant column gives 0 (M3)."""
    fit = _fitted(
        train,
        [f(c).cast("double").alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))],
    )
    fitted = df.withColumn("_fit", fit)

    def scaled(c: str) -> Column:
        low, high = F.col("_fit")[f"lo_{c}"], F.col("_fit")[f"hi_{c}"]
        return F.when(high == low, F.lit(0.0)).otherwise((F.col(c) - low) / (high - low))

    return fitted.withColumns({c: scaled(c) for c in columns}).drop("_fit")


def scale_standard(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Centred and divided by the training *population* deviation; constant columns are centred only (M4)."""
    fit = _fitted(
        train,
        [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))],
    )
    fitted = df.withColumn("_fit", fit)

    def scaled(c: str) -> Column:
        std = F.col("_fit")[f"std_{c}"]
        return (F.col(c) - F.col("_fit")[f"mean_{c}"]) / F.when(std == 0, F.lit(1.0)).otherwise(std)

    return fitted.withColumns({c: scaled(c) for c in columns}).drop("_fit")


def unscale_standard(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Inverse of :func:`scale_standard`."""
    fit = _fitted(
        train,
        [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))],
    )
    fitted = df.withColumn("_fit", fit)

    def restored(c: str) -> Column:
        std = F.col("_fit")[f"std_{c}"]
        return F.col(c) * F.when(std == 0, F.lit(1.0)).otherwise(std) + F.col("_fit")[f"mean_{c}"]

    return fitted.withColumns({c: restored(c) for c in columns}).drop("_fit")


def boxcox(c: Column | str, lam: Column | float) -> Column:
    """``(x^lambda - 1) / lambda``, ``ln x`` at 0."""
    c = F.col(c) if isinstance(c, str) else c
    lam = F.lit(float(lam)) if isinstance(lam, (int, float)) else lam
    return F.when(lam == 0, F.log(c)).otherwise((F.pow(c, lam) - 1) / F.nullif(lam, F.lit(0.0)))


def boxcox_profile(train: DataFrame, column: str, grid: Sequence[float]) -> DataFrame:
    """Profile log-likelihood per lambda, all from one pass; values <= 0 are an error naming the column."""
    x = F.col(column).cast("double")
    safe = F.when(
        x <= 0, F.raise_error(F.lit(f"{column}: Box-Cox needs values above 0")).cast("double")
    ).otherwise(x)
    data = train.select(safe.alias("x")).filter(F.col("x").isNotNull())
    wide = data.agg(
        F.count("*").alias("n"),
        F.sum(F.log("x")).alias("logs"),
        *[F.var_pop(boxcox("x", g)).alias(f"v{i}") for i, g in enumerate(grid)],
    )
    rows = [
        F.struct(
            F.lit(float(g)).alias("lam"),
            (F.lit(g - 1.0) * F.col("logs") - F.col("n") / 2 * F.log(F.col(f"v{i}"))).alias("llf"),
        )
        for i, g in enumerate(grid)
    ]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def best_lambda(profile: DataFrame) -> DataFrame:
    """One row: the most likely lambda, the smaller one on a tie."""
    return profile.agg(F.max_by("lam", F.struct("llf", -F.col("lam"))).alias("lam"))


FARTHEST = 64.0  # exponents beyond it are not looked for


def fit_boxcox(
    train: DataFrame, columns: Sequence[str], low: float = -2.0, high: float = 2.0, close: float = 1e-5, points: int = 17
) -> dict[str, float]:
    """The most likely lambda of every column, by narrowing brackets (M5).

    With u the logarithm less its mean, the likelihood is highest where the variance of (exp(lambda u) - 1) / lambda is
    lowest. Each round one aggregate gives that variance for all columns at ``points`` exponents of their brackets; the
    next bracket of a column reaches from the exponent before the best to the one after, or outwards from an end, so
    the first range is no limit. NULLs are left out; a column without two different values has no lambda (NaN);
    values <= 0 are an error naming the column.
    """
    safe = {
        c: F.when(F.col(c) <= 0, F.raise_error(F.lit(f"{c}: Box-Cox needs values above 0")).cast("double")).otherwise(F.col(c).cast("double"))
        for c in columns
    }
    aggregates = [f(x).alias(f"{n}{i}") for i, x in enumerate(safe.values()) for n, f in (("m", lambda x: F.avg(F.log(x))), ("a", F.min), ("b", F.max))]
    first = train.agg(*aggregates).first()
    found = {c: math.nan for i, c in enumerate(columns) if first[f"m{i}"] is None or first[f"a{i}"] == first[f"b{i}"]}
    centred = {c: F.log(safe[c]) - F.lit(first[f"m{i}"]) for i, c in enumerate(columns)}
    brackets = {c: (low, high) for c in columns if c not in found}
    while brackets:
        grids = {c: [a + (b - a) * i / (points - 1) for i in range(points)] for c, (a, b) in brackets.items()}
        row = train.agg(*[F.array(*[F.var_pop(_power(centred[c], g)) for g in grid]) for c, grid in grids.items()]).first()
        for (c, grid), variances in zip(grids.items(), row):
            spread = [v if v is not None and math.isfinite(v) else math.inf for v in variances]
            best = min(range(points), key=lambda j: (spread[j], j))  # noqa: B023
            lam, step, width = grid[best], grid[1] - grid[0], grid[-1] - grid[0]
            if step <= close or abs(lam) > FARTHEST:
                found[c] = lam
                del brackets[c]
            else:
                brackets[c] = (lam - (width if best == 0 else step), lam + (width if best == points - 1 else step))
    return {c: found[c] for c in columns}


def _power(u: Column, lam: float) -> Column:
    return F.expm1(u * F.lit(lam)) / F.lit(lam) if abs(lam) > 1e-12 else u


def apply_boxcox(df: DataFrame, lambdas: Mapping[str, float]) -> DataFrame:
    """Transform train or test rows with lambdas fitted on train only (Q18)."""
    bad = [c for c, lam in lambdas.items() if lam is None or math.isnan(lam)]
    if bad:
        raise ValueError(f"no lambda for {', '.join(bad)}")
    return df.withColumns({c: boxcox(c, lam) for c, lam in lambdas.items()})
