"""Upper tail probabilities for the score tables (one row per feature, so tiny)."""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * scale)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b)
        c = b + step / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def _beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta I_x(a, b) by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta(1 - x, b, a)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) / a
    c, d = 1.0, 1.0 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 10_000):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 / (1 + step * d)
            c = 1 + step / c
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


@F.pandas_udf(DoubleType())
def chi2_tail(score: pd.Series, freedom: pd.Series) -> pd.Series:
    return pd.Series(
        [None if pd.isna(x) else _gamma_upper(k / 2, x / 2) for x, k in zip(score, freedom)], dtype="float64"
    )


@F.pandas_udf(DoubleType())
def f_tail(score: pd.Series, freedom: pd.Series) -> pd.Series:
    """P(F(1, freedom) > score)."""

    def one(x: float, k: float) -> float | None:
        if pd.isna(x):
            return None
        return 0.0 if math.isinf(x) else _beta(k / (k + x), k / 2, 0.5)

    return pd.Series([one(x, k) for x, k in zip(score, freedom)], dtype="float64")


# the functions go to the workers by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def chi2_tail_even(score: Column, freedom: int) -> Column:
    """P(X >= score) for an even number of degrees of freedom, as a finite sum without a UDF."""
    if freedom < 2 or freedom % 2:
        raise ValueError("an even number of degrees of freedom from 2 on is needed")
    half = score / 2
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(freedom // 2)),
        F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda s, k: F.struct((s["sum"] + s["term"]).alias("sum"), (s["term"] * half / k).alias("term")),
        lambda s: s["sum"],
    )
    return F.exp(-half) * terms
